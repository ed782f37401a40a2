"""Registered queries over the driver's tables, one for each operator, with SQL equivalents.

``documents.text`` is the main corpus; ``part`` stands in where a sortable or
exact-value field is needed.  Queries run over a stored index of the whole table,
built once a session and input; those that change an index build their own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.analysis import CaseFolder, PolyAnalyzer, Stopalizer, Tokenizer
from glyphmill.functions.stemming import stem_column
from glyphmill.functions.stopwords import STOPWORDS
from glyphmill.operators.highlight import Highlighter, term_vectors
from glyphmill.operators.search import PolySearcher, Searcher, SortRule, SortSpec
from glyphmill.plans.parser import FlatQueryParser, QueryParser
from glyphmill.plans.query import ANDQuery, FilterQuery, MatchAllQuery, NoMatchQuery, NOTQuery, ORQuery, PhraseQuery, PrefixQuery, ProximityQuery, RangeQuery, RequiredOptionalQuery, TermQuery
from glyphmill.plans.schema import Schema, full_text, numeric, string
from glyphmill.sources.index import BackgroundMerger, Indexer, IndexReader, invert
from glyphmill.sources.reader import TextSource
from glyphmill.streaming.ingest import index_stream

ANALYZER = PolyAnalyzer(analyzers=[CaseFolder(), Tokenizer()])
STOPPED = PolyAnalyzer(analyzers=[CaseFolder(), Tokenizer(), Stopalizer("en")])
#: Words of a term in SQL: the classes that ``\w`` stands for, spelled out.
_W = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]"
_TOKENS = f"regexp_extract_all(lower(text), '{_W}+(?:[''’]{_W}+)*')"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _schema(analyzer=ANALYZER) -> Schema:
    return (
        Schema()
        .spec_field("text", full_text(analyzer, highlightable=True))
        .spec_field("lang", string(sortable=True))
        .spec_field("source", string(sortable=True))
        .spec_field("n_chars", numeric("int64", sortable=True))
    )


def _scratch(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="glyphmill-")
    return f"{base}/index-{uuid.uuid4().hex}"


def _build(spark: SparkSession, sf: str) -> str:
    """A new index of the whole table in two segments; its path."""
    path, docs = _scratch(spark), _docs(spark, sf)
    with Indexer(spark, path, _schema()) as writer:
        writer.add(docs.where("doc_id % 2 = 0")).add(docs.where("doc_id % 2 = 1")).commit()
    return path


_BUILT: dict[tuple[str, str], str] = {}


def _reader(spark: SparkSession, sf: str) -> IndexReader:
    """The index that all queries which only read share."""
    known = (spark.sparkContext.applicationId, sf)
    if known not in _BUILT:
        _BUILT[known] = _build(spark, sf)
    return IndexReader(spark, _BUILT[known])


def _searcher(spark: SparkSession, sf: str, analyzer=ANALYZER, **parser) -> Searcher:
    if analyzer is ANALYZER:
        source = _reader(spark, sf)
    else:
        source = TextSource(_docs(spark, sf), _schema(analyzer))
    return Searcher(source, QueryParser(source.schema, **({"fields": ["text"]} | parser)))


def _term(t: str) -> TermQuery:
    return TermQuery("text", t)


def _scored(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


def _all_hits(query, **options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _scored(_searcher(spark, sf, **options).collect(query))

    return run


# SQL: a document is its token list; ``leaf`` gives the frequency of each term.


def _norm_sql(n: str = "n_tokens") -> str:
    x = f"CAST(CAST(1.0 / sqrt({n}) AS FLOAT) AS DOUBLE)"
    e = f"floor(log2({x}))"
    e = f"CASE WHEN pow(2.0, {e}) > {x} THEN {e} - 1 WHEN pow(2.0, {e} + 1) <= {x} THEN {e} + 1 ELSE {e} END"
    return f"CASE WHEN {n} > 0 THEN floor({x} / pow(2.0, {e} - 2)) * pow(2.0, {e} - 2) ELSE 0.0 END"


def _leaf_sql(terms: list[str], stop: bool = False) -> str:
    """CTEs tok(doc_id, …, tokens), leaf(doc_id, …, tf0.., norm) and st(n, df0.., idf0..)."""
    tokens = _TOKENS
    if stop:
        words = ", ".join(f"'{w}'" for w in STOPWORDS["en"])
        tokens = f"list_filter({_TOKENS}, lambda x: x NOT IN ({words}))"
    tfs = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    idfs = ", ".join(f"1 + ln(n / (1.0 + df{i})) AS idf{i}" for i in range(len(terms)))
    return f"""WITH tok AS (SELECT doc_id, text, lang, source, n_chars, {tokens} AS tokens FROM documents),
leaf0 AS (SELECT doc_id, text, lang, source, n_chars, tokens, len(tokens) AS n_tokens, {tfs} FROM tok),
leaf AS (SELECT *, {_norm_sql()} AS norm FROM leaf0),
st0 AS (SELECT count(*) AS n, {dfs} FROM leaf),
st AS (SELECT *, {idfs} FROM st0)
"""


def _sql(terms: list[str], where: str, score: str, squares: str, tail: str = "", stop: bool = False, columns: str = "doc_id, round(score, 6) AS score") -> str:
    """score may use q, the query norm over ``squares``."""
    return _leaf_sql(terms, stop) + f", qn AS (SELECT st.*, CASE WHEN ({squares}) = 0 THEN 0.0 ELSE 1.0 / sqrt({squares}) END AS q FROM st)\nSELECT {columns} FROM (SELECT leaf.*, CAST({score} AS DOUBLE) AS score FROM leaf, qn WHERE {where}) {tail}"


def _w(i: int) -> str:
    return f"sqrt(tf{i}) * idf{i} * idf{i} * q * norm"


def _sq(*i: int) -> str:
    return " + ".join(f"idf{k} * idf{k}" for k in i)


def _or_sql(n: int) -> str:
    total = " + ".join(f"CASE WHEN tf{i} > 0 THEN {_w(i)} ELSE 0 END" for i in range(n))
    matched = " + ".join(f"CAST(tf{i} > 0 AS INT)" for i in range(n))
    alive = " + ".join(f"CAST(df{i} > 0 AS INT)" for i in range(n))
    return f"CASE WHEN ({alive}) < 2 THEN {total} ELSE ({total}) * ({matched}) / CAST({alive} AS DOUBLE) END"


def _phrase_sql(terms: list[str], within: int = 1) -> str:
    """Number of places where the terms stand in order, each less than ``within`` past its place."""
    tests = " AND ".join(f"len(list_filter(range(p + {i}, p + {i + within}), lambda x: tokens[x] = '{t}')) > 0" for i, t in enumerate(terms[1:], 1))
    return f"len(list_filter(range(1, len(tokens) + 1), lambda p: tokens[p] = '{terms[0]}' AND {tests}))"


_PHRASE = ["the", "that"]
_PREFIX = "whi"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


_register("term_query", _all_hits(_term("for")), _sql(["for"], "tf0 > 0", _w(0), _sq(0)))
_register("and_query", _all_hits(ANDQuery([_term("for"), _term("that"), _term("with")])), _sql(["for", "that", "with"], "tf0 > 0 AND tf1 > 0 AND tf2 > 0", f"{_w(0)} + {_w(1)} + {_w(2)}", _sq(0, 1, 2)))
_register("or_query", _all_hits(ORQuery([_term("for"), _term("und"), _term("absentword")])), _sql(["for", "und", "absentword"], "tf0 > 0 OR tf1 > 0 OR tf2 > 0", _or_sql(3), _sq(0, 1, 2)))
_register("not_query", _all_hits(NOTQuery(_term("the"))), _sql(["the"], "NOT tf0 > 0", "0.0", "0.0"))
_register("and_not_query", _all_hits(ANDQuery([_term("for"), NOTQuery(_term("that"))])), _sql(["for", "that"], "tf0 > 0 AND NOT tf1 > 0", _w(0), _sq(0)))
_register("req_opt_query", _all_hits(RequiredOptionalQuery(_term("for"), _term("with"))), _sql(["for", "with"], "tf0 > 0", f"{_w(0)} + CASE WHEN tf1 > 0 THEN {_w(1)} ELSE 0 END", _sq(0, 1)))
_register("match_all", _all_hits(MatchAllQuery(boost=1.5)), "SELECT doc_id, CAST(1.5 AS DOUBLE) AS score FROM documents")
_register("no_match", _all_hits(NoMatchQuery()), "SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE false")
_register("range_query", _all_hits(RangeQuery("n_chars", 100, 2000, include_upper=False)), "SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE n_chars >= 100 AND n_chars < 2000")
_register("range_in_boolean", _all_hits(ANDQuery([_term("for"), RangeQuery("n_chars", 500)])), _sql(["for"], "tf0 > 0 AND n_chars >= 500", _w(0), f"{_sq(0)} + 1.0"))
_register("filter_query", _all_hits(ANDQuery([_term("that"), FilterQuery(_term("for"))])), _sql(["that", "for"], "tf0 > 0 AND tf1 > 0", _w(0), f"{_sq(0)} + 1.0"))
_register("prefix_query", _all_hits(PrefixQuery("text", _PREFIX)), f"SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents) WHERE len(list_filter(tokens, lambda x: starts_with(x, '{_PREFIX}'))) > 0")
_register("exact_field_query", _all_hits(ANDQuery([TermQuery("lang", "de"), FilterQuery(TermQuery("source", "src3"))])), f"WITH st AS (SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'de') AS df FROM documents) SELECT doc_id, round((1 + ln(n / (1.0 + df))) * (1 + ln(n / (1.0 + df))) / sqrt((1 + ln(n / (1.0 + df))) * (1 + ln(n / (1.0 + df))) + 1.0), 6) AS score FROM documents, st WHERE lang = 'de' AND source = 'src3'")


def _phrase_oracle(terms: list[str], within: int) -> str:
    base = _leaf_sql(terms).replace("leaf AS (SELECT *,", f"leaf AS (SELECT *, {_phrase_sql(terms, within)} AS pf,")
    idf = " + ".join(f"idf{i}" for i in range(len(terms)))
    return base + f"SELECT doc_id, round(sqrt(pf) * ({idf}) * ({idf}) / abs({idf}) * norm, 6) AS score FROM leaf, st WHERE pf > 0"


def _with_phrase(sql: str) -> str:
    """SQL whose leaf rows also hold pf, the number of times the phrase stands there."""
    return sql.replace("leaf AS (SELECT *,", f"leaf AS (SELECT *, {_phrase_sql(_PHRASE)} AS pf,")


_register("phrase_query", _all_hits(PhraseQuery("text", _PHRASE)), _phrase_oracle(_PHRASE, 1))
_register("proximity_query", _all_hits(ProximityQuery("text", _PHRASE, 4)), _phrase_oracle(_PHRASE, 4))


def _parsed(text: str, **parser):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _scored(_searcher(spark, sf, **parser).collect(text))

    return run


_register("parsed_query_or", _parsed("+for that -with"), _sql(["for", "with", "that"], "tf0 > 0 AND NOT tf1 > 0", f"{_w(0)} + CASE WHEN tf2 > 0 THEN {_w(2)} ELSE 0 END", f"{_sq(0)} + {_sq(2)}"))
_register("parsed_query_and", _parsed("for (that OR with)", default_boolop="AND"), _sql(["for", "that", "with"], "tf0 > 0 AND (tf1 > 0 OR tf2 > 0)", f"{_w(0)} + (CASE WHEN tf1 > 0 THEN {_w(1)} ELSE 0 END + CASE WHEN tf2 > 0 THEN {_w(2)} ELSE 0 END) * (CAST(tf1 > 0 AS INT) + CAST(tf2 > 0 AS INT)) / 2.0", _sq(0, 1, 2)))
_register("stopwords", _parsed("from the with hand", analyzer=STOPPED), _sql(["hand"], "tf0 > 0", _w(0), _sq(0), stop=True))
_register("parsed_pure_negation", _parsed("-for -that"), "SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE false")
_register("parsed_double_negation", _parsed("--for AND NOT with"), _sql(["for", "with"], "tf0 > 0 AND NOT tf1 > 0", _w(0), _sq(0)))
_register("parsed_stray_operators", _parsed("AND for OR OR that AND"), _sql(["for", "that"], "tf0 > 0 OR tf1 > 0", _or_sql(2), _sq(0, 1)))
_register("parsed_precedence", _parsed("with OR for AND that"), _sql(["for", "that", "with"], "tf2 > 0 OR (tf0 > 0 AND tf1 > 0)", f"(CASE WHEN tf2 > 0 THEN {_w(2)} ELSE 0 END + CASE WHEN tf0 > 0 AND tf1 > 0 THEN {_w(0)} + {_w(1)} ELSE 0 END) * (CAST(tf2 > 0 AS INT) + CAST(tf0 > 0 AND tf1 > 0 AS INT)) / 2.0", _sq(0, 1, 2)))
_IN_DE = "(1 + ln(n / (1.0 + (SELECT count(*) FROM documents WHERE lang = 'de'))))"
_register("parsed_fields", _parsed("lang:de AND text:und", heed_colons=True), _sql(["und"], "tf0 > 0 AND lang = 'de'", f"{_w(0)} + (SELECT {_IN_DE} * {_IN_DE} FROM st) * q", f"{_sq(0)} + {_IN_DE} * {_IN_DE}"))
_register("parsed_escapes", _parsed(r"text:for\: OR text:that", heed_colons=True), _sql(["for", "that"], "tf0 > 0 OR tf1 > 0", _or_sql(2), _sq(0, 1)))
_register("boosted_terms", _all_hits(ORQuery([TermQuery("text", "for", boost=2.0), _term("that")])), _sql(["for", "that"], "tf0 > 0 OR tf1 > 0", f"(CASE WHEN tf0 > 0 THEN 2 * {_w(0)} ELSE 0 END + CASE WHEN tf1 > 0 THEN {_w(1)} ELSE 0 END) * (CAST(tf0 > 0 AS INT) + CAST(tf1 > 0 AS INT)) / 2.0", "4 * idf0 * idf0 + idf1 * idf1"))
_register("one_term_phrase", _all_hits(PhraseQuery("text", ["for"])), _sql(["for"], "tf0 > 0", _w(0), _sq(0)))
_register("empty_phrase", _all_hits(PhraseQuery("text", [])), "SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE false")


def _stop_tokens(spark: SparkSession, sf: str) -> DataFrame:
    terms = STOPPED.terms(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(terms).cast("bigint").alias("n_tokens"))


_register("stopword_lengths", _stop_tokens, _leaf_sql(["x"], stop=True) + "SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens FROM leaf")

TOP = 20


def _top(spec: SortSpec | None = None, offset: int = 0, num: int = TOP):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = _searcher(spark, sf).top_docs(ORQuery([_term("for"), _term("that")]), num, offset, spec, round_score=6)
        return found.select("doc_id", "score") if spec is None else found.select("doc_id")

    return run


def _top_sql(order: str, tail: str, columns: str = "doc_id, round(score, 6) AS score") -> str:
    return _sql(["for", "that"], "tf0 > 0 OR tf1 > 0", _or_sql(2), _sq(0, 1), f"ORDER BY {order} {tail}", columns=columns)


_register("top_k", _top(), _top_sql("round(score, 6) DESC, doc_id", f"LIMIT {TOP}"))
_register("paging", _top(offset=15), _top_sql("round(score, 6) DESC, doc_id", f"LIMIT {TOP} OFFSET 15"))
_register("sort_field_asc", _top(SortSpec([SortRule("field", "lang"), SortRule("field", "n_chars")])), _top_sql("lang ASC NULLS LAST, n_chars ASC NULLS LAST, doc_id", f"LIMIT {TOP}", "doc_id"))
_register("sort_field_desc_nulls_first", _top(SortSpec([SortRule("field", "n_chars", True)])), _top_sql("n_chars DESC NULLS FIRST, doc_id", f"LIMIT {TOP}", "doc_id"))
_register("sort_doc_id_reverse", _top(SortSpec([SortRule("doc_id", None, True)])), _top_sql("doc_id DESC", f"LIMIT {TOP}", "doc_id"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    found = _searcher(spark, sf).hits(_term("for"), 10)
    return found.select("doc_id", "lang", "n_chars", F.round("score", 4).alias("score"))


_register("hits_with_stored_fields", _hits, _sql(["for"], "tf0 > 0", _w(0), _sq(0), "ORDER BY score DESC, doc_id LIMIT 10", columns="doc_id, lang, n_chars, round(score, 4) AS score"))


def _total_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _searcher(spark, sf).collect("for OR that", need_score=False).agg(F.count("*").alias("total_hits"))


_register("total_hits", _total_hits, _leaf_sql(["for", "that"]) + "SELECT count(*) AS total_hits FROM leaf WHERE tf0 > 0 OR tf1 > 0")


def _facets(spark: SparkSession, sf: str) -> DataFrame:
    return _searcher(spark, sf).collect("for OR that", ["lang"], need_score=False).groupBy("lang").agg(F.count("*").alias("n"))


_register("collector_counts", _facets, _leaf_sql(["for", "that"]) + "SELECT lang, count(*) AS n FROM leaf WHERE tf0 > 0 OR tf1 > 0 GROUP BY lang")


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    schema = Schema().spec_field("text", full_text(ANALYZER))
    rows = invert(_docs(spark, sf).select("doc_id", "text"), schema, "doc_id")
    return rows.select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"), F.round("norm", 9).alias("norm"), F.element_at("positions", 1).cast("bigint").alias("first_position"), F.element_at("positions", -1).cast("bigint").alias("last_position"))


_EXPLODED = f"""WITH tok AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
pos AS (SELECT doc_id, len(tokens) AS n_tokens, unnest(tokens) AS term, unnest(range(len(tokens))) AS p FROM tok)
"""
_register("postings_build", _postings, _EXPLODED + f"SELECT term, doc_id, count(*) AS tf, round({_norm_sql('any_value(n_tokens)')}, 9) AS norm, min(p) AS first_position, max(p) AS last_position FROM pos GROUP BY term, doc_id")


def _lexicon(seek: str | None = None):
    return lambda spark, sf: _reader(spark, sf).lexicon("text", seek).select("term", "doc_freq")


_register("lexicon_seek", _lexicon("was"), _EXPLODED + "SELECT term, count(DISTINCT doc_id) AS doc_freq FROM pos WHERE term >= 'was' GROUP BY term")
_register("lexicon_scan", _lexicon(), _EXPLODED + "SELECT term, count(DISTINCT doc_id) AS doc_freq FROM pos GROUP BY term")


def _norms(spark: SparkSession, sf: str) -> DataFrame:
    kind = _schema().fields["text"]
    n = F.size(ANALYZER.terms(F.col("text")))
    return _docs(spark, sf).select("doc_id", n.cast("bigint").alias("n_tokens"), F.round(kind.sim().field_norm(n, F.lit(1.0)), 9).alias("norm"))


_register("norms", _norms, _leaf_sql(["x"]) + "SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, round(norm, 9) AS norm FROM leaf")


def _stems(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of each language with their stems: null where the language has no stemmer, or is null."""
    words = _docs(spark, sf).select("lang", F.explode(F.array_distinct(ANALYZER.terms(F.col("text")))).alias("word")).distinct()
    return words.select("lang", "word", F.element_at(stem_column(F.array("word"), F.col("lang")), 1).alias("stem"))


_register("stemmed_vocabulary", _stems)


def _excerpts(spark: SparkSession, sf: str) -> DataFrame:
    searcher = _searcher(spark, sf)
    query = searcher.glean('for "the that"')
    return searcher.hits(query, 10).select("doc_id", Highlighter(query, searcher.schema, "text", weigh=searcher.weigher(query)).column("text").alias("excerpt"))


_register("highlighted_excerpts", _excerpts)


def _index_build(spark: SparkSession, sf: str) -> DataFrame:
    """Builds an index; its documents and postings by field."""
    reader = IndexReader(spark, _build(spark, sf))
    return reader.lexicon().groupBy("field").agg(F.sum("doc_freq").alias("n_postings"), F.lit(reader.doc_count()).cast("bigint").alias("n_docs"))


_register("index_build", _index_build, _EXPLODED + """SELECT field, CAST(n_postings AS BIGINT) AS n_postings, (SELECT count(*) FROM documents) AS n_docs FROM (
SELECT 'text' AS field, count(*) AS n_postings FROM (SELECT DISTINCT term, doc_id FROM pos)
UNION ALL SELECT 'lang', count(lang) FROM documents UNION ALL SELECT 'source', count(source) FROM documents)""")


def _index_search(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(Searcher(_reader(spark, sf)).collect(ORQuery([_term("for"), _term("und"), PhraseQuery("text", _PHRASE)])))


_PHRASE_W = "sqrt(pf) * (idf2 + idf3) * (idf2 + idf3) * q * norm"
_register("stored_index_search", _index_search, _with_phrase(_sql(["for", "und", *_PHRASE], "tf0 > 0 OR tf1 > 0 OR pf > 0", f"(CASE WHEN tf0 > 0 THEN {_w(0)} ELSE 0 END + CASE WHEN tf1 > 0 THEN {_w(1)} ELSE 0 END + CASE WHEN pf > 0 THEN {_PHRASE_W} ELSE 0 END) * (CAST(tf0 > 0 AS INT) + CAST(tf1 > 0 AS INT) + CAST(pf > 0 AS INT)) / 3.0", "idf0 * idf0 + idf1 * idf1 + (idf2 + idf3) * (idf2 + idf3)")))
_register("parsed_phrase", _parsed('+for "the that"'), _with_phrase(_sql(["for", "und", *_PHRASE], "tf0 > 0", f"{_w(0)} + CASE WHEN pf > 0 THEN {_PHRASE_W} ELSE 0 END", "idf0 * idf0 + (idf2 + idf3) * (idf2 + idf3)")))


def _text_search(spark: SparkSession, sf: str) -> DataFrame:
    """No index: texts are analyzed as they are read."""
    return _scored(Searcher(TextSource(_docs(spark, sf), _schema())).collect(ORQuery([_term("for"), _term("that")])))


_register("text_scan_search", _text_search, _sql(["for", "that"], "tf0 > 0 OR tf1 > 0", _or_sql(2), _sq(0, 1)))


def _set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    searcher = _searcher(spark, sf)
    a, b, c, d = (searcher.docset(q) for q in (_term("for"), _term("that"), _term("und"), RangeQuery("n_chars", None, 300)))
    found = ((a & b) ^ c) | (d - a)
    return found.flipped(searcher.docset(MatchAllQuery())).ids


_register("docset_algebra", _set_algebra, _leaf_sql(["for", "that", "und"]) + "SELECT doc_id FROM leaf WHERE NOT coalesce((tf0 > 0 AND tf1 > 0) <> (tf2 > 0) OR (n_chars <= 300 AND NOT tf0 > 0), false)")


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A kept set of documents as a filter; it has no part in the score."""
    searcher = _searcher(spark, sf)
    return _scored(searcher.collect(_term("that"), within=searcher.docset(_term("for"))))


_register("docset_filter", _filtered, _sql(["that", "for"], "tf0 > 0 AND tf1 > 0", _w(0), _sq(0)))


def _sort_values(spark: SparkSession, sf: str) -> DataFrame:
    return _reader(spark, sf).unique_values("source")


_register("unique_sort_values", _sort_values, "SELECT source, count(*) AS n_docs FROM documents GROUP BY source")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    path = _build(spark, sf)
    with Indexer(spark, path) as writer:
        writer.delete_by_term("text", "that").delete_by_doc_id(5).commit()
    reader = IndexReader(spark, path)
    return spark.createDataFrame([(reader.doc_max(), reader.del_count(), reader.doc_count())], "doc_max bigint, del_count bigint, doc_count bigint")


_register("document_counts", _counts, _leaf_sql(["that"]) + "SELECT count(*) AS doc_max, count(*) FILTER (WHERE tf0 > 0 OR doc_id = 5) AS del_count, count(*) FILTER (WHERE NOT (tf0 > 0 OR doc_id = 5)) AS doc_count FROM leaf")


def _updated(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth document gets a new text; old texts count in statistics until a merge."""
    path = _build(spark, sf)
    new = _docs(spark, sf).where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("for for updated "), F.coalesce("text", F.lit(""))))
    with Indexer(spark, path) as writer:
        writer.add(new, replace=True).commit()
    return _scored(Searcher(IndexReader(spark, path)).collect(ORQuery([_term("for"), _term("updated")])))


_OLD_AND_NEW = """WITH versions AS (SELECT doc_id, text, lang, source, CASE WHEN doc_id % 10 = 0 THEN -1 ELSE 1 END AS n_chars FROM documents
UNION ALL SELECT doc_id, 'for for updated ' || coalesce(text, ''), lang, source, 1 FROM documents WHERE doc_id % 10 = 0),
tok"""
_register("update_by_key", _updated, _sql(["for", "updated"], "(tf0 > 0 OR tf1 > 0) AND n_chars > 0", _or_sql(2), _sq(0, 1)).replace("WITH tok", _OLD_AND_NEW).replace("AS tokens FROM documents)", "AS tokens FROM versions)"))


def _added(spark: SparkSession, sf: str) -> DataFrame:
    """A whole index copied into another under shifted keys."""
    path = _scratch(spark)
    with Indexer(spark, path, _schema()) as writer:
        writer.add_index(_reader(spark, sf), shift=1_000_000).commit()
    return _scored(Searcher(IndexReader(spark, path)).collect(ORQuery([_term("for"), _term("that")])))


_register("add_index", _added, _sql(["for", "that"], "tf0 > 0 OR tf1 > 0", _or_sql(2), _sq(0, 1), columns="doc_id + 1000000 AS doc_id, round(score, 6) AS score"))


def _merged_behind(spark: SparkSession, sf: str) -> DataFrame:
    """Segments merged while another session deletes; both changes hold."""
    path = _build(spark, sf)
    merger = BackgroundMerger(spark, path).prepare()
    with Indexer(spark, path) as writer:
        writer.delete_by_term("text", "that").commit()
    merger.commit()
    return _scored(Searcher(IndexReader(spark, path)).collect(_term("for")))


_register("background_merge", _merged_behind, _sql(["for", "that"], "tf0 > 0 AND NOT tf1 > 0", _w(0), _sq(0)))


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents indexed as a stream, then searched."""
    path, docs = _scratch(spark), _docs(spark, sf)
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parquet*")
    index_stream(stream, path, _schema(), f"{path}-progress").awaitTermination()
    return _scored(Searcher(IndexReader(spark, path)).collect(_term("for")))


_register("streaming_index", _streamed, _sql(["for"], "tf0 > 0", _w(0), _sq(0)))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and character offsets of each term of each document, joined by commas."""
    found = term_vectors(_reader(spark, sf).stored(), _schema(), "text")
    return found.select("doc_id", "term", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("positions", "starts", "ends")))


# A token ends after all tokens up to it and all that stands before each of them.
_register(
    "term_vectors",
    _vectors,
    f"""WITH parts AS (SELECT doc_id, {_TOKENS} AS tokens, string_split_regex(lower(text), '{_W}+(?:[''’]{_W}+)*') AS gaps FROM documents WHERE text IS NOT NULL),
one AS (SELECT doc_id, unnest(range(len(tokens))) AS p, unnest(tokens) AS term, unnest(gaps[1:len(tokens)]) AS gap FROM parts),
placed AS (SELECT doc_id, term, p, sum(length(gap) + length(term)) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM one)
SELECT doc_id, term, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions,
       string_agg(CAST(e - length(term) AS VARCHAR), ',' ORDER BY p) AS starts, string_agg(CAST(e AS VARCHAR), ',' ORDER BY p) AS ends
FROM placed GROUP BY doc_id, term""",
)


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    """Words and prefixes without operators; a prefix scores 1."""
    source = _reader(spark, sf)
    return _scored(Searcher(source).collect(FlatQueryParser(source.schema, ["text"]).parse(f"for {_PREFIX}*")))


_HAS_PREFIX = f"len(list_filter(tokens, lambda x: starts_with(x, '{_PREFIX}'))) > 0"
_register("flat_parsed_query", _flat, _sql(["for"], f"tf0 > 0 OR {_HAS_PREFIX}", f"(CASE WHEN tf0 > 0 THEN {_w(0)} ELSE 0 END + CASE WHEN {_HAS_PREFIX} THEN 1 ELSE 0 END) * (CAST(tf0 > 0 AS INT) + CAST({_HAS_PREFIX} AS INT)) / 2.0", f"{_sq(0)} + 1.0"))


def _long_field(spark: SparkSession, sf: str) -> DataFrame:
    """Texts under a hundred tokens get no bonus for being short."""
    schema = Schema().spec_field("text", full_text(ANALYZER, similarity="long_field"))
    return _scored(Searcher(TextSource(_docs(spark, sf), schema)).collect(ORQuery([_term("for"), _term("that")])))


_register("long_field_similarity", _long_field, _sql(["for", "that"], "tf0 > 0 OR tf1 > 0", _or_sql(2), _sq(0, 1)).replace(_norm_sql(), _norm_sql("greatest(n_tokens, 100)")))


def _deleted(spark: SparkSession, sf: str) -> DataFrame:
    path = _build(spark, sf)
    with Indexer(spark, path) as writer:
        writer.delete_by_term("text", "that").delete_by_query(RangeQuery("n_chars", None, 200)).commit()
    return _scored(Searcher(IndexReader(spark, path)).collect(_term("for")))


_register("delete_by_term_and_query", _deleted, _sql(["for", "that"], "tf0 > 0 AND NOT tf1 > 0 AND NOT n_chars <= 200", _w(0), _sq(0)))


def _multi(spark: SparkSession, sf: str) -> DataFrame:
    docs, schema = _docs(spark, sf), _schema()
    parts = [Searcher(TextSource(docs.where(f"doc_id % 2 = {i}"), schema)) for i in (0, 1)]
    return _scored(PolySearcher(parts, [0, 0]).collect(ORQuery([_term("for"), _term("that")])))


_register("multi_index_search", _multi, _sql(["for", "that"], "tf0 > 0 OR tf1 > 0", _or_sql(2), _sq(0, 1)))


def _doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    reader = _reader(spark, sf)
    return reader.lexicon("text").where(F.col("term").isin("for", "that", "und")).select("term", "doc_freq")


_register("doc_freq", _doc_freq, _EXPLODED + "SELECT term, count(DISTINCT doc_id) AS doc_freq FROM pos WHERE term IN ('for', 'that', 'und') GROUP BY term")


def _posting_list(spark: SparkSession, sf: str) -> DataFrame:
    reader = _reader(spark, sf)
    return reader.posting_list("text", "und").select("doc_id", F.col("tf").cast("bigint").alias("tf"))


_register("posting_list_scan", _posting_list, _EXPLODED + "SELECT doc_id, count(*) AS tf FROM pos WHERE term = 'und' GROUP BY doc_id")


def _optimized(spark: SparkSession, sf: str) -> DataFrame:
    path = _build(spark, sf)
    with Indexer(spark, path) as writer:
        writer.delete_by_term("text", "that").optimize().commit()
    reader = IndexReader(spark, path)
    return reader.lexicon("text").select("term", "doc_freq")


_register("optimize_after_deletes", _optimized, _EXPLODED + "SELECT term, count(DISTINCT doc_id) AS doc_freq FROM pos WHERE doc_id NOT IN (SELECT doc_id FROM pos WHERE term = 'that') GROUP BY term")


def _part_search(spark: SparkSession, sf: str) -> DataFrame:
    schema = Schema().spec_field("p_name", full_text(ANALYZER)).spec_field("p_brand", string(sortable=True)).spec_field("p_size", numeric("int32", sortable=True))
    parts = spark.read.parquet(f"{sf}/part.parquet")
    found = Searcher(TextSource(parts, schema, key="p_partkey")).collect(ANDQuery([RangeQuery("p_size", 10, 20), NOTQuery(RangeQuery("p_brand", "Brand#3", None))]), ["p_size"])
    return found.select("p_partkey", "p_size")


_register("range_on_exact_fields", _part_search, "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT p_brand >= 'Brand#3'")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A parsed query over all documents, ranked, with stored fields."""
    return _searcher(spark, sf).hits('+for that "the that"', TOP).select("doc_id", "lang", "source", F.round("score", 6).alias("score"))


__all__ = ["ORACLE", "QUERIES", "flagship"]
