"""Stemmed vocabulary: every language, against single words."""

from glyphmill.functions.stemming import STEMMERS, stem_word
from glyphmill.operators import catalog


def test_vocabulary_of_all_languages(spark, tmp_path):
    docs = [("en", "running horses"), ("de", "die Häuser running"), ("es", "las canciones"), ("sv", "flickorna"), ("da", "husene"), ("no", "husene"), ("fr", "les chansons"), (None, "running")]
    spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(docs)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {tuple(r) for r in catalog.QUERIES["stemmed_vocabulary"](spark, str(tmp_path)).select("lang", "word", "stem").collect()}
    assert rows == {(x, w, stem_word(w, x) if x in STEMMERS else None) for x, t in docs for w in t.lower().split()}
