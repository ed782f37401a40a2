"""Search over texts and over stored indexes: counts, order, and plain set models."""

import math
import random

import pytest

from glyphmill.functions import similarity as sim
from glyphmill.functions.analysis import CaseFolder, PolyAnalyzer, Stemmer, Stopalizer, Tokenizer, analyzer_from_json, register_analyzer
from glyphmill.functions.stemming import english
from glyphmill.operators.highlight import HeatMap, Highlighter, Span, query_spans, sentences
from glyphmill.operators.search import PolySearcher, Searcher, SortRule, SortSpec
from glyphmill.operators.simple import Simple
from glyphmill.plans.parser import QueryParser
from glyphmill.plans.query import ANDQuery, FilterQuery, MatchAllQuery, NoMatchQuery, NOTQuery, ORQuery, PhraseQuery, PrefixQuery, ProximityQuery, RangeQuery, RequiredOptionalQuery, TermQuery, from_json
from glyphmill.plans.schema import Schema, blob, full_text, numeric, string
from glyphmill.sources.index import BackgroundMerger, Folder, Indexer, IndexReader, Lock, LockError, choose_sparse, fibonacci, purge
from glyphmill.sources.reader import TextSource

SEVEN = ["x", "y", "z", "x a", "x a b", "x a b c", "x foo a b c d"]
PLAIN = Tokenizer(r"\S+")


def schema(analyzer=PLAIN, **fields):
    out = Schema().spec_field("content", full_text(analyzer, highlightable=True))
    for name, kind in fields.items():
        out.spec_field(name, kind)
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


@pytest.fixture(params=["texts", "index"])
def seven(request, spark, tmp_path):
    return lambda analyzer=PLAIN, texts=SEVEN: source(request.param, spark, tmp_path, schema(analyzer), frame(spark, texts))


def source(kind, spark, tmp_path, fields, docs):
    if kind == "texts":
        return TextSource(docs, fields)
    path = f"{tmp_path}/i{random.random()}"
    with Indexer(spark, path, fields, partitions=2) as writer:
        writer.add(docs.where("doc_id % 2 = 0")).add(docs.where("doc_id % 2 = 1"))
        writer.commit()
    return IndexReader(spark, path)


# Query string → hits with OR, AND, OR with stop word x, AND with stop word x.
COUNTS = {
    "b": (3, 3, 3, 3), "(a)": (4, 4, 4, 4), '"a"': (4, 4, 4, 4), '"(a)"': (0, 0, 0, 0), '("a")': (4, 4, 4, 4),
    "a b": (4, 3, 4, 3), 'a ("b")': (4, 3, 4, 3), 'a "(b)"': (4, 0, 4, 0), '"a b"': (3, 3, 3, 3), "a (b c)": (4, 2, 4, 2),
    '"a b c"': (2, 2, 2, 2), "-x": (0, 0, 0, 0), "x -c": (3, 3, 0, 0), 'x "-c"': (5, 0, 0, 0), "x +c": (2, 2, 2, 2),
    "+x -c": (3, 3, 0, 0), "-x +c": (0, 0, 2, 2), "-x -c": (0, 0, 0, 0), "x y": (6, 0, 1, 1),
}


def test_query_strings(spark, seven):
    searchers = []
    for analyzer in (PLAIN, PolyAnalyzer(analyzers=[PLAIN, Stopalizer(stoplist=["x"])])):
        src = seven(analyzer)
        searchers += [Searcher(src, QueryParser(src.schema, op)) for op in ("OR", "AND")]
    for text, expected in COUNTS.items():
        assert tuple(s.total_hits(text) for s in searchers) == expected, text


@pytest.mark.parametrize(
    "text,op,tree",
    [
        ("a b", "OR", "(a OR b)"), ("a b", "AND", "(a AND b)"), ("(a)", "OR", "(a)"), ("a (b)", "AND", "(a AND (b))"), ("--a", "OR", "a"),
        ("---a", "OR", "-a"), ("a +b", "OR", "(+b a)"), ("a AND b", "OR", "(a AND b)"), ("a OR b AND c", "AND", "(a OR (b AND c))"),
        ("-(-(a))", "OR", "-(-(a))"), ("a -b", "OR", "(-b AND a)"), ("+a +b c", "OR", "(+(a AND b) c)"), ("OR a AND AND OR b AND", "OR", "(a OR b)"),
        ("NOT AND", "OR", "[NOMATCH]"), ("()", "OR", "()"), ("a NOT b", "AND", "(a AND -b)"), ('"a b', "OR", '"a b'), ("(a b", "OR", "(a OR b)"),
        ("ANDy ORb", "OR", "(ANDy OR ORb)"), ("a-b", "OR", "a-b"), ("", "OR", "[NOMATCH]"),
    ],
)
def test_trees(text, op, tree):
    assert str(QueryParser(schema(), op).tree(text)) == tree


def test_fields_and_escapes():
    fields = schema(title=full_text(PLAIN), tag=string(), n=numeric("int32"))
    parser = QueryParser(fields, heed_colons=True)
    assert str(parser.parse("title:a")) == "title:a"
    assert str(parser.parse("title:(a b)")) == "(title:a OR title:b)"
    assert str(parser.parse("http://x")) == "(content:http://x OR tag:http://x OR title:http://x)"
    assert str(parser.parse('title:"a b"')) == 'title:"a b"'
    assert parser.parse(r"title:a\:b").term == "a:b"
    assert str(QueryParser(fields).parse("title:a")).startswith("(content:title:a")
    assert isinstance(parser.parse("none:a"), NoMatchQuery)
    with pytest.raises(ValueError):
        QueryParser(fields, "XOR")


def test_pruning():
    parser = QueryParser(schema())
    assert isinstance(parser.parse("-a"), NoMatchQuery) and isinstance(parser.prune(MatchAllQuery()), NoMatchQuery)
    assert str(parser.prune(ORQuery([TermQuery("content", "a"), NOTQuery(TermQuery("content", "b"))]))) == "(content:a OR [NOMATCH])"
    assert parser.prune(ANDQuery([NOTQuery(TermQuery("content", "a")), NOTQuery(TermQuery("content", "b"))])).clauses == []


def test_pruning_keeps_exclusions_of_exclusions_apart():
    parser, a, b = QueryParser(schema()), TermQuery("content", "a"), TermQuery("content", "b")
    assert str(parser.prune(NOTQuery(NOTQuery(a)))) == "[NOMATCH]"
    assert str(parser.prune(ANDQuery([a, NOTQuery(NOTQuery(b))]))) == "(content:a AND -[MATCHALL])"
    assert str(parser.prune(ANDQuery([a, NOTQuery(b)]))) == "(content:a AND -content:b)"
    assert str(parser.prune(RequiredOptionalQuery(NOTQuery(a), b))) == "(+[NOMATCH] content:b)"
    assert str(parser.prune(a)) == "content:a"


def test_set_models(spark, seven):
    """Boolean operators over generated sets: word mK is in the documents K divides."""
    texts = [" ".join(f"m{k}" for k in (2, 3, 5, 7) if i % k == 0) or "none" for i in range(60)]
    searcher = Searcher(seven(PLAIN, texts))
    term = lambda k: TermQuery("content", f"m{k}")
    has = lambda k: {i for i in range(60) if i % k == 0}
    ids = lambda q: {r.doc_id for r in searcher.collect(q).collect()}
    assert ids(ANDQuery([term(2), term(3), term(5)])) == has(2) & has(3) & has(5)
    assert ids(ORQuery([term(3), term(7), TermQuery("content", "absent")])) == has(3) | has(7)
    assert ids(ANDQuery([term(2), TermQuery("content", "absent")])) == set()
    assert ids(ANDQuery([term(2), NOTQuery(term(3))])) == has(2) - has(3)
    assert ids(NOTQuery(ORQuery([term(2), term(3)]))) == set(range(60)) - has(2) - has(3)
    assert ids(RequiredOptionalQuery(term(5), term(2))) == has(5)
    assert ids(FilterQuery(term(7))) == has(7)
    assert ids(MatchAllQuery()) == set(range(60)) and ids(NoMatchQuery()) == set()
    assert ids(ORQuery([])) == set() and ids(PhraseQuery("content", [])) == set()
    assert ids(PrefixQuery("content", "no")) == {i for i, t in enumerate(texts) if t == "none"}
    assert {r.score for r in searcher.collect(PrefixQuery("content", "m")).collect()} == {1.0}


def test_phrases_and_proximity(spark, seven):
    texts = ["a b c a b c a b c d", "a b c d x x a", "a c b d", "x a b c d a b c d", "a x b", "b a", "a x x b", "a a b"]
    searcher = Searcher(seven(PLAIN, texts))
    ids = lambda q: sorted(r.doc_id for r in searcher.collect(q).collect())
    for terms in (["a", "b"], ["a", "b", "c", "d"], ["c", "a"], ["a"], ["a", "a"]):
        n = len(terms)
        plain = [i for i, t in enumerate(texts) if any(t.split()[p : p + n] == terms for p in range(len(t.split())))]
        assert ids(PhraseQuery("content", terms)) == plain
    for within in (1, 2, 3):
        plain = [i for i, t in enumerate(texts) if any(x == "a" and y == "b" and 0 <= q - p - 1 < within for p, x in enumerate(t.split()) for q, y in enumerate(t.split()))]
        assert ids(ProximityQuery("content", ["a", "b"], within)) == plain
    top = searcher.top_docs(PhraseQuery("content", ["a", "b", "c", "d"]), 1).first()
    assert top.doc_id in (1, 3)


def test_scores_by_hand(spark, seven):
    texts = ["a a b", "a c", "b", "c c c c"]
    searcher = Searcher(seven(PLAIN, texts))
    idf = lambda df: 1 + math.log(4 / (1 + df))
    norm = lambda n: sim.decode_norm(sim.encode_norm(1 / math.sqrt(n)))
    rows = {r.doc_id: r.score for r in searcher.collect("a b").collect()}
    q = 1 / math.sqrt(idf(2) ** 2 * 2)
    w = idf(2) ** 2 * q
    assert rows[0] == pytest.approx((math.sqrt(2) + 1) * w * norm(3))
    assert rows[1] == pytest.approx(w * norm(2) / 2) and rows[2] == pytest.approx(w * norm(1) / 2)
    opt = {r.doc_id: r.score for r in searcher.collect(RequiredOptionalQuery(TermQuery("content", "a"), TermQuery("content", "b"))).collect()}
    assert opt[1] == pytest.approx(w * norm(2)) and opt[0] == pytest.approx(rows[0])
    one = {r.doc_id: r.score for r in searcher.collect(TermQuery("content", "a")).collect()}
    assert one[0] == pytest.approx(math.sqrt(2) * idf(2) * norm(3))
    assert {r.score for r in searcher.collect(MatchAllQuery(boost=2.5)).collect()} == {2.5}
    doubled = {r.doc_id: r.score for r in searcher.collect(ORQuery([TermQuery("content", "a"), TermQuery("content", "b")], boost=2.0)).collect()}
    assert doubled[0] == pytest.approx(rows[0] / 2)


def test_norms(spark):
    assert [sim.decode_norm(b) for b in (100, 110, 120, 130, 140)] == [0.015625, 0.09375, 0.5, 3.0, 16.0]
    assert [sim.encode_norm(sim.decode_norm(b)) for b in range(256)] == list(range(256))
    from pyspark.sql import functions as F

    df = spark.range(1, 5000).select("id", sim.norm_column(1.0 / F.sqrt(F.col("id").cast("double"))).alias("v"))
    assert all(r.v == sim.decode_norm(sim.encode_norm(1 / math.sqrt(r.id))) for r in df.collect())
    assert sim.Similarity().idf(3, 0) == 1 and sim.Similarity().coord(1, 0) == 1 and sim.Similarity().query_norm(0) == 0
    long = spark.createDataFrame([(1,), (100,), (400,), (0,)], "n int").select(sim.LongFieldSimilarity().length_norm(F.col("n")).alias("v"))
    assert [r.v for r in long.collect()] == [0.1, 0.1, 0.05, 0.0]


def test_analysis(spark):
    poly = PolyAnalyzer("en")
    assert poly.split("The Running-dogs' isn’t RUNNING") == ["the", "run", "dog", "isn't", "run"]
    stop = PolyAnalyzer(analyzers=[CaseFolder(), Tokenizer(), Stopalizer("en")])
    chains = [poly, stop, Tokenizer(), CaseFolder(), PolyAnalyzer(analyzers=[Tokenizer(), CaseFolder(), Stemmer("de")])]
    texts = ["The quick, brown Fox's", "", "Häuser über Straßen", "O'Neill éa ça_va 12"]
    for a in chains:
        df = frame(spark, texts)
        rows = df.select(a.terms(df.content).alias("t")).collect()
        assert [r.t for r in rows] == [a.split(t) for t in texts]
        assert analyzer_from_json(a.to_json()) == a
    assert Tokenizer().spans([("ab, çd", 0, 6)]) == [("ab", 0, 2), ("çd", 4, 6)]
    with pytest.raises(ValueError):
        Tokenizer(r"\pL+")
    with pytest.raises(ValueError):
        Stemmer("xx")


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("flies", "fli"), ("dying", "die"), ("hoping", "hope"), ("hopping", "hop"), ("national", "nation"), ("conditional", "condit"), ("generously", "generous"), ("happy", "happi"), ("relational", "relat"), ("consignment", "consign"), ("knightly", "knight"), ("kneeling", "kneel"), ("skies", "sky"), ("agreed", "agre"), ("controlled", "control"), ("by", "by"), ("say", "say"), ("cry", "cri")])
def test_english_stems(word, stem):
    assert english(word) == stem


def test_sort_paging_and_nulls(spark, tmp_path):
    fields = Schema().spec_field("name", string(sortable=True)).spec_field("speed", numeric("int32", sortable=True)).spec_field("nope", full_text(PLAIN))
    rows = [(0, "car", 5, "v"), (1, "boat", None, "v"), (2, None, 9, "v"), (3, "bike", 5, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, name string, speed int, nope string")
    for kind in ("texts", "index"):
        s = Searcher(source(kind, spark, tmp_path, fields, docs))
        ids = lambda *rules, s=s, **kw: [r.doc_id for r in s.top_docs(TermQuery("nope", "v"), sort=SortSpec(rules), **kw).collect()]
        assert ids(SortRule("field", "name")) == [3, 1, 0, 2]
        assert ids(SortRule("field", "name", True)) == [2, 0, 1, 3]
        assert ids(SortRule("field", "speed"), SortRule("doc_id", None, True)) == [3, 0, 2, 1]
        assert ids(SortRule("field", "speed"), num_wanted=2, offset=1) == [3, 2]
        assert [r.score for r in s.top_docs(TermQuery("nope", "v"), sort=SortSpec([SortRule("doc_id")])).collect()] == [None] * 4
        in_range = lambda q, s=s: sorted(r.doc_id for r in s.collect(q).collect())
        assert in_range(RangeQuery("name", "bike", "car", include_upper=False)) == [1, 3]
        assert in_range(RangeQuery("speed", 5)) == [0, 2, 3] and in_range(RangeQuery("speed", 5, include_lower=False)) == [2]
        assert in_range(RangeQuery("speed", 9, nulls_match_open_upper=True)) == [1, 2]
        with pytest.raises(ValueError):
            s.top_docs(TermQuery("nope", "v"), sort=SortSpec([SortRule("field", "nope")]))
        with pytest.raises(ValueError):
            s.collect(RangeQuery("nope", "a"))
        hits = s.hits(TermQuery("nope", "v"), 2).collect()
        assert [h.name for h in hits] == ["car", "boat"]
    with pytest.raises(ValueError):
        RangeQuery("name")
    with pytest.raises(ValueError):
        SortSpec([])


def test_query_objects_travel():
    q = ANDQuery([ORQuery([TermQuery("a", "b", boost=2.0), PhraseQuery("a", ["x", "y"])]), NOTQuery(RangeQuery("n", "h", "m", True, False)), RequiredOptionalQuery(FilterQuery(MatchAllQuery()), ProximityQuery("a", ["x", "y"], 3)), PrefixQuery("a", "f")])
    assert from_json(q.to_json()) == q
    assert str(RangeQuery("name", "h", "m", True, False)) == "name:[h TO m}"


def test_schema_grows_only():
    s = schema(n=numeric("int64"), b=blob())
    assert Schema.loads(s.dumps()) == s
    with pytest.raises(ValueError):
        s.spec_field("n", numeric("int32"))
    with pytest.raises(ValueError):
        blob(sortable=True)
    assert numeric("float64").sortable and not numeric("int32").sortable


def test_boosts(spark, tmp_path):
    fields = Schema().spec_field("content", full_text(PLAIN)).spec_field("category", full_text(PLAIN, boost=100.0))
    docs = spark.createDataFrame([(0, "x a", "y", 1.0), (1, "y", "x", 1.0), (2, "x a", "y", 4.0)], "doc_id long, content string, category string, boost double")
    src = TextSource(docs, fields, boost="boost")
    assert [r.doc_id for r in Searcher(src).top_docs("x").collect()] == [1, 2, 0]


def test_index_life(spark, tmp_path):
    path = f"{tmp_path}/life"
    fields = schema()
    for i, text in enumerate(["a", "b", "c", "a b"]):
        with Indexer(spark, path, fields, partitions=1) as w:
            w.add(spark.createDataFrame([(i, text)], "doc_id long, content string"))
            w.commit()
    old = IndexReader(spark, path)
    assert (old.doc_max(), old.doc_count(), len(old.manifest.segments)) == (4, 4, 4)
    assert [r.term for r in old.lexicon("content", "b").orderBy("term").collect()] == ["b", "c"]
    assert old.doc_freq("content", "a") == 2 and old.fetch_doc(2).content == "c"
    with Indexer(spark, path) as w:
        w.delete_by_term("content", "a zzz").delete_by_query(TermQuery("content", "c"))
        with pytest.raises(LockError):
            Indexer(spark, path, timeout=0.0)
        w.commit()
    now = IndexReader(spark, path)
    assert (now.doc_max(), now.del_count(), now.doc_count()) == (4, 3, 1)
    assert now.doc_freq("content", "a") == 2  # counts deleted documents until a merge
    assert Searcher(now).total_hits("a b c") == 1 and Searcher(old).total_hits("a b c") == 4
    assert Searcher(now).total_hits(MatchAllQuery()) == 1
    with Indexer(spark, path) as w:
        w.optimize().commit()
    merged = IndexReader(spark, path)
    assert (merged.doc_max(), merged.doc_freq("content", "a"), len(merged.manifest.segments)) == (1, 0, 1)
    assert Searcher(merged).total_hits("b") == 1
    gone = purge(spark, path)
    assert len([g for g in gone if g.startswith("docs/seg=")]) == 4 and Searcher(IndexReader(spark, path)).total_hits("b") == 1
    with Indexer(spark, path, fields, truncate=True) as w:
        w.add(frame(spark, ["z"])).commit()
    assert Searcher(IndexReader(spark, path)).total_hits("b z") == 1
    with pytest.raises(ValueError), Indexer(spark, path) as w:
        w.add(spark.createDataFrame([(1, "a")], "doc_id long, unknown string"))
    assert Lock(Folder(spark, path), "write", 0.0).obtain()


def test_background_merge_keeps_late_changes(spark, tmp_path):
    path = f"{tmp_path}/bg"
    for i, text in enumerate("abc"):
        with Indexer(spark, path, schema(), partitions=1) as w:
            w.add(spark.createDataFrame([(i, text)], "doc_id long, content string")).commit()
    merger = BackgroundMerger(spark, path).prepare()
    with Indexer(spark, path) as w:
        w.add(spark.createDataFrame([(9, "d")], "doc_id long, content string")).delete_by_term("content", "b").commit()
    merger.commit()
    reader = IndexReader(spark, path)
    assert len(reader.manifest.segments) == 2
    assert sorted(r.content for r in reader.stored().collect()) == ["a", "c", "d"]


def test_add_index_and_poly_searcher(spark, tmp_path):
    a = source("index", spark, tmp_path, schema(), frame(spark, ["a x", "b x"]))
    b = source("index", spark, tmp_path, schema(), frame(spark, ["a w", "c z", "a a"]))
    both = PolySearcher([Searcher(a), Searcher(b)], [0, 100])
    assert sorted(r.doc_id for r in both.collect("a").collect()) == [0, 100, 102]
    with Indexer(spark, f"{tmp_path}/sum", schema()) as w:
        w.add_index(a).add_index(b, shift=100).commit()
    one = Searcher(IndexReader(spark, f"{tmp_path}/sum"))
    expected = [(r.doc_id, round(r.score, 9)) for r in one.top_docs("a x").collect()]
    assert [(r.doc_id, round(r.score, 9)) for r in both.top_docs("a x").collect()] == expected
    with pytest.raises(ValueError):
        PolySearcher([Searcher(a), Searcher(TextSource(frame(spark, ["q"]), schema(CaseFolder())))])


def test_merge_policy():
    assert [fibonacci(i) for i in range(8)] == [0, 1, 1, 2, 3, 5, 8, 13]
    assert choose_sparse([1] * 18 + [100, 100]) == 18
    assert choose_sparse([]) == 0 and choose_sparse([1000, 1000, 1000]) == 0


def test_highlighting(spark):
    fields = schema(PolyAnalyzer(analyzers=[CaseFolder(), Tokenizer()]))
    body = "1 2 3 4 5 " * 20 + "Φ a b c d x y z h i j k " + "6 7 8 9 0 " * 20
    parser = QueryParser(fields)
    hl = Highlighter(parser.parse('"x y z" AND φ'), fields, "content")
    out = hl.excerpt(body)
    assert "<strong>x y z</strong>" in out and "<strong>&#934;</strong>" in out
    assert out.startswith("&#8230;") and out.endswith("&#8230;")
    quotes = Highlighter(parser.parse("blind"), fields, "content")
    assert quotes.excerpt('"I see," said the blind man.') == "&quot;I see,&quot; said the <strong>blind</strong> man."
    assert quotes.excerpt(None) is None and quotes.excerpt("") == ""
    rows = frame(spark, ["a blind x", None]).select(quotes.column("content").alias("e")).collect()
    assert [r.e for r in rows] == ["a <strong>blind</strong> x", None]
    tokens = fields.fields["content"].analyzer.spans([("x y, z x y z", 0, 12)])
    assert [s.offset for s in query_spans(PhraseQuery("content", ["x", "y", "z"]), "content", tokens)] == [0, 7]
    heat = HeatMap([], 100)
    assert heat.lift(Span(0, 2, 1.0), Span(2, 2, 1.0)) == 2.0 and heat.lift(Span(0, 2, 1.0), Span(200, 2, 1.0)) == 0.0
    assert HeatMap.flatten([Span(10, 10, 1.0), Span(16, 14, 2.0)]) == [Span(10, 6, 1.0), Span(16, 4, 3.0), Span(20, 10, 2.0)]
    assert [(s.offset, s.length) for s in sentences("Ab c. De 3.5 f.  G")] == [(0, 5), (6, 9)]
    with pytest.raises(ValueError):
        Highlighter(MatchAllQuery(), schema(t=full_text(PLAIN)), "t")


def test_fragments_and_raw_excerpts():
    """What the reference gives for these texts."""
    fields = schema(PolyAnalyzer(analyzers=[CaseFolder(), Tokenizer()]))
    sized = lambda n: Highlighter(TermQuery("content", "x"), fields, "content", n)
    heat = lambda *spans: HeatMap([Span(*s) for s in spans], 133)
    for text, hot, expected in (("a Φ Φ b c", (2, 1, 1.0), (2, "Φ Φ b")), ("aaΦ", (2, 1, 1.0), (0, "aaΦ")), ("aaaabΦΦ", (6, 2, 1.0), (4, "bΦΦ")), ("aΦbcde", (0, 1, 1.0), (0, "aΦbcd"))):
        assert sized(3).fragment(text, heat(hot)) == expected
    ook, ick, urk = "Ook.  Urk.  Ick.  ", "Ook urk ick i.", "Urk.  Iz no good."
    for text, top, piece, bounds, expected in (
        (ook, 0, "Ook.  Urk.", [(0, 4), (6, 4)], (0, "Ook.")),
        (ook, 3, ".  Urk.  I", [(6, 4), (12, 4)], (6, "Urk.")),
        (ick, 8, "ick i.", [(0, 14)], (10, "… i.")),
        (urk, 4, "  Iz no go", [(6, 11)], (6, "Iz no…")),
    ):
        assert sized(6).raw_excerpt(text, heat((0, len(text), 1.0)), top, piece, [Span(*b) for b in bounds]) == expected
    assert sized(3).highlight_excerpt("a b c", [Span(2, 1)]) == "a <strong>b</strong> c"
    assert sized(3).highlight_excerpt("Φ Φ Φ", [Span(3, 1)], 1) == "&#934; <strong>&#934;</strong> &#934;"
    text = "This is a sentence. " * 15
    assert [(s.offset, s.length) for s in sentences(text, 101, 50)] == [(120, 19), (140, 19)] and sentences(text, 101, 4) == []
    assert [(s.offset, s.length) for s in sentences(text)] == [(20 * i, 19) for i in range(15)]
    # However a text is cut, an excerpt keeps to its length and to the text.
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice(["x", "yy", "Zed.", "long-word", "é!", "a"]) for _ in range(rng.randint(0, 60))]
        text, n = rng.choice(["", " "]) + " ".join(words), rng.randint(3, 60)
        hl = sized(n)
        spans = query_spans(hl.query, "content", hl.analyzer.spans([(text, 0, len(text))]))
        start, raw = hl.raw_excerpt(text, HeatMap(spans, max(n * 2 // 3, 1)))
        body = raw.removeprefix("… ").removesuffix("…")
        assert len(raw) <= n and body in text


def test_simple_facade(spark, tmp_path):
    s = Simple(spark, f"{tmp_path}/simple", "en")
    s.add(frame(spark, ["running dogs", "a cat runs", "none"]))
    s.add(spark.createDataFrame([(7, "dog")], "doc_id long, content string"))
    assert s.total_hits("dogs") == 2 and {r.doc_id for r in s.search("run").collect()} == {0, 1}


def test_streaming(spark, tmp_path):
    from glyphmill.streaming.ingest import index_stream

    for part, texts in enumerate((["a b", "c"], ["a"])):
        spark.createDataFrame([(10 * part + i, t) for i, t in enumerate(texts)], "doc_id long, content string").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    for _ in range(2):
        stream = spark.readStream.schema("doc_id long, content string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        index_stream(stream, f"{tmp_path}/ix", schema(), f"{tmp_path}/ck").awaitTermination(120)
    reader = IndexReader(spark, f"{tmp_path}/ix")
    assert reader.doc_count() == 3 and Searcher(reader).total_hits("a") == 2


def test_plan_of_text_search_has_one_scan_and_no_join(spark):
    df = Searcher(TextSource(frame(spark, SEVEN), schema())).top_docs("a AND (b OR c) -d", 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "TakeOrderedAndProject" in plan


def test_flat_parser(spark):
    from glyphmill.plans.parser import FlatQueryParser

    fields = schema()
    parser = FlatQueryParser(fields)
    assert str(parser.parse('a fo* "b c"')) == '(content:a OR content:fo* OR content:"b c")'
    assert isinstance(parser.parse(""), NoMatchQuery)
    assert Searcher(TextSource(frame(spark, SEVEN), fields), parser).total_hits("fo* z") == 2


@pytest.mark.parametrize("language,word,stem", [("de", "häuser", "haus"), ("de", "aufgabenstellungen", "aufgabenstell"), ("sv", "jaktkarlarne", "jaktkarl"), ("da", "undersøgelserne", "undersøg"), ("no", "havnemyndighetene", "havnemynd"), ("es", "chicas", "chic"), ("es", "checar", "chec"), ("es", "chilena", "chilen"), ("es", "torneo", "torne"), ("es", "toreros", "torer"), ("es", "naciones", "nacion"), ("es", "rápidamente", "rapid")])
def test_other_stems(language, word, stem):
    from glyphmill.functions.stemming import stem_word

    assert stem_word(word, language) == stem


class Whispering(Tokenizer):
    """Never registered."""


class Shouting(Tokenizer):
    """Upper-case words weigh three times as much."""

    def __init__(self):
        super().__init__(r"\S+")

    def options(self):
        return {}

    def terms(self, text):
        from pyspark.sql import functions as F

        return F.transform(super().terms(text), F.lower)

    def boosts(self, text):
        from pyspark.sql import functions as F

        return F.transform(super().terms(text), lambda t: F.when(t == F.upper(t), F.lit(3.0)).otherwise(F.lit(1.0)))

    def spans(self, tokens):
        return [(t.lower(), a, b) for t, a, b in super().spans(tokens)]


@pytest.mark.parametrize("kind", ["texts", "index"])
def test_posting_kinds(spark, tmp_path, kind):
    texts = ["a x", "A x x x x", "A a", "b"]
    with pytest.raises(ValueError):
        full_text(Whispering()).to_json()
    register_analyzer("shouting", Shouting)
    rich = Schema().spec_field("content", full_text(Shouting(), posting="rich"))
    scores = {r.doc_id: r.score for r in Searcher(source(kind, spark, tmp_path, rich, frame(spark, texts))).collect(TermQuery("content", "a")).collect()}
    w = 1 + math.log(4 / 4)
    assert scores == {0: pytest.approx(w), 1: pytest.approx(3 * w), 2: pytest.approx(math.sqrt(2) * 2 * w)}
    match = Schema().spec_field("content", full_text(Shouting(), posting="match"))
    assert len({r.score for r in Searcher(source(kind, spark, tmp_path, match, frame(spark, texts))).collect(TermQuery("content", "a")).collect()}) == 1
    with pytest.raises(ValueError):
        full_text(PLAIN, posting="odd")
