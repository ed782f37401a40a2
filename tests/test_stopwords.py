"""Stop lists: the languages of the reference, whole lists, columns as for single texts."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.analysis import CaseFolder, PolyAnalyzer, Stopalizer, Tokenizer
from glyphmill.operators import catalog


def test_languages_and_sizes():
    sizes = {x: len(Stopalizer(x).words) for x in "da de en es fi fr hu it nl no pt ru sv".split()}
    assert sizes == {"da": 94, "de": 231, "en": 174, "es": 313, "fi": 229, "fr": 170, "hu": 198, "it": 279, "nl": 101, "no": 172, "pt": 203, "ru": 151, "sv": 114}
    assert Stopalizer("EN").words == Stopalizer("en").words
    with pytest.raises(ValueError):
        Stopalizer("xx")


@pytest.mark.parametrize("language,text,kept", [("en", "I am about what they DON'T say after all of your walrus", ["say", "walrus"]), ("sv", "och jag såg det i skogen", ["såg", "skogen"]), ("it", "nella casa della nonna", ["casa", "nonna"]), ("fr", "cette maison sans les quelles", ["maison"])])
def test_words_are_dropped(spark, language, text, kept):
    chain = PolyAnalyzer(analyzers=[CaseFolder(), Tokenizer(), Stopalizer(language)])
    assert chain.split(text) == kept
    assert spark.createDataFrame([(text,)], "t string").select(chain.terms(F.col("t"))).first()[0] == kept


def test_registered_lengths_use_the_whole_list(spark, tmp_path):
    spark.createDataFrame([(1, "about what been hers couldn't tree")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["stopword_lengths"](spark, str(tmp_path)).first().n_tokens == 1
