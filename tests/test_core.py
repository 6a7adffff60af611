"""The search core against brute force, unit vectors and edge cases."""

import datetime
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsearch.functions import codec, distance, html, stem, text
from loomsearch.operators import boolean, corpus, enrich, expansion, ingest, postings, ranked, results, spelling, suggest
from loomsearch.operators.postings import build_postings
from loomsearch.plans import query as language
from loomsearch.plans.engine import FrequencyCache, ResultCache, SearchEngine
from loomsearch.plans.store import IndexStore
from loomsearch.sources import files
from loomsearch.streaming import ingest as stream

DOCS = [
    (1, "Central bank\nThe bank of England raised rates. The bank said so."),
    (2, "England bank holiday\nA holiday in England, bank closed."),
    (3, "Rates\nRates rose; rates fell. No bank."),
    (4, None),
    (5, ""),
    (6, "été ça 12 _x_ ²\nword word word"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def brute_index(stopping=True):
    index = {}
    for doc, body in DOCS:
        words = [w for w in re.findall(r"[^\W]+", (body or "").lower()) if re.search("[a-z0-9]", w)]
        words = [w for w in words if not (stopping and w in text.STOP_WORDS)]
        for p, w in enumerate(words, 1):
            index.setdefault(w, {}).setdefault(doc, []).append(p)
    return index


def test_postings_equal_brute_force(spark, docs):
    for stopping in (True, False):
        got = {}
        for r in postings.build_postings(docs, stopping).collect():
            got.setdefault(r.term, {})[r.doc_id] = r.positions
            assert r.tf == len(r.positions)
        assert got == brute_index(stopping)
    assert postings.build_postings(docs.limit(0)).count() == 0


def evaluate(tree, index, universe):
    def leaf(operand):
        if operand.kind == "word":
            return set(index.get(operand.words[0], {}))
        if operand.kind == "phrase":
            first, *later = operand.words
            return {d for d, ps in index.get(first, {}).items() if any(all(p + i in index.get(w, {}).get(d, ()) for i, w in enumerate(later, 1)) for p in ps)}
        a, b = operand.words
        return {d for d, ps in index.get(a, {}).items() if any(abs(p - q) <= operand.distance for p in ps for q in index.get(b, {}).get(d, ()))}

    return language.folded(tree, leaf, lambda x, y: x & y, lambda x, y: x | y, lambda x: universe - x)


def random_query(rng, depth=0):
    word = lambda: rng.choice(["bank", "england", "rates", "holiday", "zzz", "the"])
    pick = rng.random()
    if depth > 2 or pick < 0.4:
        return word()
    if pick < 0.5:
        return f'"{word()} {word()}"'
    if pick < 0.6:
        return f"#{rng.randrange(4)}({word()}, {word()})"
    if pick < 0.7:
        return f"NOT {random_query(rng, 3)}"
    return f"({random_query(rng, depth + 1)} {rng.choice(['AND', 'OR'])} {random_query(rng, depth + 1)})"


def test_boolean_equals_brute_force(spark, docs):
    rng = random.Random(8)
    index = postings.build_postings(docs).persist()
    brute, universe = brute_index(), {d for d, _ in DOCS}
    for _ in range(25):
        q = random_query(rng)
        tree = language.parse(q, stemming=False)
        want = evaluate(tree, brute, universe) if tree else set()
        assert {r.doc_id for r in boolean.search(index, docs, q, stemming=False).collect()} == want, q


@pytest.mark.parametrize(
    ("query", "valid"),
    [("a AND b", True), ("a NOT b", False), ("a AND NOT b", True), ("NOT NOT a", True), ("AND a", True), ("a OR", True), ("a AND OR b", False), ("(a", False), ("a) b", False), ("()", True), ("(a) b", False), ("a b", True), ("", True), ("(OR a)", False), ("'a b'", True)],
)
def test_validation(query, valid):
    assert language.check(query, stopping=False, stemming=False) is valid


def test_language_quirks():
    plain = {"stopping": False, "stemming": False}
    assert language.parse("a OR b AND c", **plain) == language.Node("AND", (language.Node("OR", (language.Leaf("word", ("a",)), language.Leaf("word", ("b",)))), language.Leaf("word", ("c",))))
    assert language.parse("a b", **plain) == language.Leaf("word", ("b",))
    assert language.parse("AND a", **plain) is None and language.parse("()", **plain) is None and language.parse("", **plain) is None
    assert language.parse("'a b'", **plain).kind == "word"
    # a stop word in a proximity operand leaves its last word
    assert language.parse("#2(the, bank)", stemming=False).kind == "word"
    assert language.load_queries(["1: a AND b", "", "2:x: y"]) == [("1", "a AND b"), ("2", "x: y")]


def test_ranked(spark, docs):
    import math

    index = postings.build_postings(docs)
    brute = brute_index()
    got = {r.doc_id: r.score for r in ranked.tfidf(index, "Bank bank rates zzz the", 6).collect()}
    want = {}
    for term, times in (("bank", 2), ("rates", 1)):
        for doc, places in brute[term].items():
            want[doc] = want.get(doc, 0) + times * (1 + math.log10(len(places))) * math.log10(6 / len(brute[term]))
    assert got == pytest.approx(want) and all(x >= 0 for x in got.values())
    assert ranked.tfidf(index, "zzz", 6).count() == 0 and ranked.tfidf(index, "", 6).count() == 0
    top = ranked.top(ranked.tfidf(index, "bank", 6), 2).orderBy("rank").collect()
    assert [r.rank for r in top] == [1, 2] and top[0].score >= top[1].score


def test_bm25_by_hand(spark):
    import math

    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 2, 1)], "term string, doc_id long, tf int")
    lengths = spark.createDataFrame([(1, 4), (2, 2), (3, 3)], "doc_id long, dl int")
    got = {r.doc_id: r.score for r in ranked.bm25(rows, lengths, "a A", 3).collect()}
    idf = math.log10(3 / 2)
    assert got[1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / 3)))
    only = ranked.bm25(rows, lengths, "a", 3, included=spark.createDataFrame([(2,), (2,)], "doc_id long")).collect()
    assert [r.doc_id for r in only] == [2]


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("rational", "ration"), ("digitizer", "digit"), ("operator", "oper"),
        ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("formaliti", "formal"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"),
        ("allowance", "allow"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
        ("dying", "die"), ("news", "news"), ("at", "at"), ("flies", "fli"), ("dies", "die"),
    ],
)
def test_stems(word, want):
    assert stem.stem(word) == want


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_osa_bounds(a, b):
    d = distance.osa(a, b)
    assert d == distance.osa(b, a) and abs(len(a) - len(b)) <= d <= suggest.levenshtein(a, b)
    assert (d == 0) == (a == b)


def test_codec(spark):
    rows = [([],), (None,), ([5],), ([1, 2, 9],), ([3, 3, 3],), (list(range(1, 3000)),)]
    df = spark.createDataFrame(rows, "p array<int>")
    got = df.select("p", codec.delta_encoded(F.col("p")).alias("e")).withColumn("d", codec.delta_decoded("e")).collect()
    assert all(r.p == r.d for r in got) and got[3].e == [1, 1, 7]


@pytest.mark.parametrize("mode", ["first", "last"])
def test_merge(spark, mode):
    a = spark.createDataFrame([("x", 1, [1]), ("y", 1, [2])], "term string, doc_id long, positions array<int>")
    b = spark.createDataFrame([("x", 1, [7]), ("x", 2, [8])], "term string, doc_id long, positions array<int>")
    got = {(r.term, r.doc_id): r.positions for r in postings.merged(a, b, mode).collect()}
    assert got == {("x", 1): [1] if mode == "first" else [7], ("y", 1): [2], ("x", 2): [8]}


def test_numbered(spark):
    rows = spark.range(0, 997).select((F.col("id") * 7 % 997).alias("k")).repartition(5)
    got = postings.numbered(rows, ["k"], 100).orderBy("k").collect()
    assert [r.doc_id for r in got] == list(range(100, 1097))
    assert postings.numbered(rows.limit(0), ["k"]).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("AbC12def--x_y:z!", 'a  (b)\t"c"', "https://www.site.example/news/uk/long-story/x", None)], "n string, t string, u string, z string")
    r = df.select(
        text.node_name(F.col("n")).alias("node"),
        text.plain_word(F.col("n")).alias("plain"),
        text.clean_markup_text(F.col("t")).alias("markup"),
        text.url_source(F.col("u")).alias("source"),
        text.url_topic(F.col("u")).alias("topic"),
        text.url_topic(F.col("u"), None).alias("full"),
        text.url_host(F.col("u")).alias("host"),
        text.tokens(F.col("z")).alias("none"),
        text.lead(F.lit("a.b.c.d")).alias("lead"),
        text.any_day(F.lit("3 May 2024")).alias("day"),
        text.any_day(F.lit("nonsense")).alias("no_day"),
    ).first()
    assert r.node == text.node_name_of("AbC12def--x_y:z!") == "abc 12 def x_y:z" and r.plain == "abc12def-x_y:z"
    assert (r.markup, r.source, r.topic, r.full, r.host, r.none, r.lead) == ("a b c", "site", "news-uk", "news-uk-long-story", "www.site.example", [], "a.b.c")
    assert str(r.day) == "2024-05-03" and r.no_day is None


PAGE = """<html><h1>A "big"
 (story)</h1><script>var p = "</p>";</script><p>One <a href="/x">link</a> and <a href="/y">more</a><p>Two</p><p>Three <a>bare</a></p><!-- <p>no</p> --><p>Four</p>
<figure><figcaption>It's "here"</figcaption></figure><figcaption>two</figcaption></html>"""


def test_html(spark):
    got = html.extracted(PAGE)
    assert got == {"title": "A big story", "content": "One link and more Two Three bare Four", "hypertext": {"link": "/x", "bare": html.NO_LINK}, "figcaption": {"0": "Its here", "1": "two"}}
    assert html.extracted("<p>a</p><p>b</p><p>c</p>")["content"] is None and html.extracted(None)["title"] == ""
    assert html.listed('<article><h2><a href="/a">t</a></h2><time datetime="2024-01-02">x</time></article><article>none</article>') == [{"loc": "/a", "lastmod": "2024-01-02"}]
    df = spark.createDataFrame([(1, PAGE, "old"), (2, None, "old")], "page_id long, html string, title string")
    rows = {r.page_id: r for r in html.extract_pages(df).collect()}
    assert rows[1].title == "A big story" and rows[1].hypertext["link"] == "/x" and rows[2].content is None
    assert html.extract_links(spark.createDataFrame([('<article><a href="/a">t</a></article>',)], "html string")).count() == 1


def test_results(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(7)], "doc_id long, score double")
    order = [F.desc("score"), F.asc("doc_id")]
    assert [r.doc_id for r in results.page(rows, 2, 3, order).orderBy("rank").collect()] == [4, 0, 3]
    assert results.page(rows, 9, 3, order).count() == 0 and results.page_count(7, 3) == 3
    window = results.page_window(rows, 1, 3, 7, order).collect()
    assert len(window) == 7 and {r.page for r in window} == {1, 2, 3}
    with pytest.raises(ValueError):
        results.checked_request("", 1, 10)
    with pytest.raises(ValueError):
        results.checked_request("a", 0, 10)
    sentiments = spark.createDataFrame([(1, '["negative:0.2","neutral:0.3","positive:0.5"]'), (2, "broken"), (3, None), (4, '["positive:0.5","neutral:0.5","positive:x"]')], "doc_id long, s string").withColumn("p", results.sentiment_parts(F.col("s")))
    assert [r.doc_id for r in results.with_sentiment(sentiments, "positive", F.col("p")).collect()] == [1]
    records = spark.createDataFrame([(1, "t", "clash")], "doc_id long, title string, score string")
    page = results.enriched(results.page(rows, 1, 2, order), records, ["title"]).collect()
    assert {r.doc_id: r.title for r in page} == {2: None, 5: None}


def test_spelling(spark):
    vocab = spark.createDataFrame([("council", 50), ("counsel", 20), ("bridge", 40), ("the", 900), ("market", 30), ("opened", 9)], "word string, count long")
    corrector = spelling.Corrector(vocab)
    assert corrector.correct("the counsil opend a brigde") == "the council opened a bridge"
    assert corrector.correct("coun cil") == "council" and corrector.correct("themarket") == "the market"
    assert corrector.correct("zzzzzz 2024") == "zzzzzz 2024" and corrector.correct("") == ""
    words = spark.createDataFrame([("counsil",), ("council",), ("qqqqqq",), (None,)], "query string")
    assert {r["query"]: r.word for r in spelling.best_words(words, vocab).collect()} == {"counsil": "council", "council": "council", "qqqqqq": "qqqqqq"}


def test_suggestions():
    s = suggest.Suggester([("council", 50), ("councillor", 20), ("counter", 10), ("bridge", 40), ("council bridge", 9), ("market", 30)])
    assert s.suggest("coun") == [" council", " councillor", " counter"]
    assert s.suggest("old brid") [0].endswith("bridge") and s.suggest("") == []
    assert " market" in s.suggest("markat")
    assert s.walk("council brid") == (["council"], "brid", "")
    s.set_count("counter", 99)
    assert s.suggest("coun")[0] == " counter" and s.count_of("market") == 30 and s.count_of("zz") is None


def test_suggestions_beyond_the_bound(spark, monkeypatch):
    rows = [("council", 50), ("councillor", 20), ("counter", 10), ("bridge", 40), ("council bridge", 9), ("market", 30), ("co-op", 3), ("harbour", 1), ("cafe9", 1)]
    dictionary = spark.createDataFrame(rows, "text string, count long")
    small = suggest.Suggester.of(dictionary, synonyms={"market": ["bazaar"]})
    monkeypatch.setattr(suggest, "MAX_ENTRIES", 4)
    large = suggest.Suggester.of(dictionary, synonyms={"market": ["bazaar"]})
    assert large.suggest("harb") == [" harbour"] and large.suggest("harbuor") == small.suggest("harbuor") and large.count_of("harbour") == 1
    for query in ("coun", "old brid", "", "markat", "council brid", "harbor", "co op", "cafe 9", "baz", "zzzz", "council bridgf"):
        assert large.suggest(query) == small.suggest(query), query
    assert large.walk("council brid") == small.walk("council brid")
    for s in (small, large):
        s.set_count("counter", 99)
    assert large.suggest("coun") == small.suggest("coun") and large.count_of("zz") is None


def test_corpus(spark, docs):
    pairs = {(r["first"], r["second"]): r["count"] for r in corpus.bigram_counts(docs).collect()}
    assert pairs["word", "word"] == 2 and ("bank", "the") not in pairs and pairs["of", "england"] == 1
    vocab = corpus.vocabulary(docs)
    kept = {r.doc_id: r.text for r in corpus.filtered_corpus(docs, vocab, 2).collect()}
    assert kept[4] == kept[5] == "" and kept[6] == "word word word"
    assert corpus.suggestion_dictionary(docs.limit(0)).count() == 0


def test_enrichment(spark):
    content = "First one here. Second here. The bridge was opened by the mayor. A dog barked."
    assert enrich.title_sentence("Mayor opens bridge", content) == "The bridge was opened by the mayor"
    assert enrich.title_sentence("t", "One. Two.") is None and enrich.title_sentence(None, content) is None
    assert enrich.ranked_sentences("T", "A cat sat. A cat ran. A cat sat down. Dogs bark.", 2).startswith("T\nA cat")
    assert enrich.ranked_sentences("T", "One. Two.", 5) is None and enrich.ranked_sentences("T", None, 1) is None
    df = spark.createDataFrame([(1, "good bank won"), (2, None)], "doc_id long, t string")
    parts = {r.doc_id: r.parts for r in enrich.scored_sentiment(df, F.col("t"), enrich.word_list_scorer).collect()}
    assert sum(parts[1]) == pytest.approx(1) and parts[2] is None
    got = spark.createDataFrame([([0.1, 0.2, 0.7],), (None,)], "p array<double>").select(enrich.sentiment_entries(F.col("p")).alias("s")).collect()
    assert [r.s for r in got] == ['["negative:0.10","neutral:0.20","positive:0.70"]', '["negative:0.00","neutral:1.00","positive:0.00"]']


def test_ingest(spark):
    links = spark.createDataFrame([("a", "2024-01-02T03:04", "s", 1), ("a", "2024-02-01", "s", 2), ("b", None, "s", 1), (None, "2024-01-01", "s", 1)], "loc string, lastmod string, source string, fetched_at int")
    one = ingest.distinct_links(links)
    assert {r.loc: r.lastmod for r in one.collect()} == {"a": "2024-02-01", "b": None}
    assert [r.loc for r in ingest.recent_links(one, F.lit("2024-02-10").cast("date"), 30).collect()] == ["a"]
    assert [r.loc for r in ingest.new_links(one, spark.createDataFrame([("a",), (None,)], "url string")).collect()] == ["b"]
    maps = spark.createDataFrame([("{'a': '/x'}",), ("{'a': 'it's'}",), (None,)], "m string").select(ingest.decoded_map(F.col("m")).alias("d")).collect()
    assert maps[0].d == {"a": "/x"} and maps[1].d == {"a": "it's"} and maps[2].d is None
    fragments = spark.createDataFrame([("s", 1, None), ("s", 2, None)], "source string, frag_index int, crawl_date date")
    assert [r.frag_index for r in postings.unprocessed(fragments, fragments.where("frag_index = 1")).collect()] == [2]


def test_files(spark, tmp_path):
    day = tmp_path / "abc"
    day.mkdir()
    (day / "abc_data_20240102_0.csv").write_text('source,title,date,content,hypertext,figcaption,url,doc_id\nabc,"A ""t""",2024/01/02,"two\nlines",,,u1,1\n', encoding="utf-8")
    (day / "abc_data_20240102_3.csv").write_text("source,title,date,content,hypertext,figcaption,url,doc_id\nabc,B,,,,,u2,2\n", encoding="utf-8")
    (day / "xyz_data_20240103_0.csv").write_text("source,title,date,content,hypertext,figcaption,url,doc_id\nxyz,C,,,,,u3,3\n", encoding="utf-8")
    listed = {(r.source, str(r.crawl_date), r.frag_index) for r in files.list_fragments(spark, str(tmp_path)).collect()}
    assert listed == {("abc", "2024-01-02", 0), ("abc", "2024-01-02", 3), ("xyz", "2024-01-03", 0)}
    rows = {r.doc_id: r for r in files.read_fragments(spark, str(tmp_path), "abc", "2024-01-02").collect()}
    assert set(rows) == {1, 2} and rows[1].content == "two\nlines" and rows[1].title == 'A "t"' and rows[2].content == ""
    assert [r.doc_id for r in files.read_fragments(spark, str(tmp_path), "abc", first=1, last=3).collect()] == [2]
    (tmp_path / "map.xml").write_text("<urlset><url><loc>a</loc><lastmod>2024-01-02</lastmod></url><url><loc>b</loc></url></urlset>", encoding="utf-8")
    assert sorted((r.loc, r.lastmod) for r in files.read_sitemap(spark, str(tmp_path / "map.xml")).collect()) == [("a", "2024-01-02"), ("b", None)]
    index = spark.createDataFrame([("b", 1, [1, 2]), ("a", 2, [3]), ("a", 10, [4])], "term string, doc_id long, positions array<int>")
    files.write_index_text(index, str(tmp_path / "index"))
    assert "\n".join(r.value for r in files.read_lines(spark, str(tmp_path / "index")).collect()).startswith("a 2\n\t2: 3\n\t10: 4")
    for form in ("parquet", "orc", "json"):
        files.write_table(index, str(tmp_path / form), form=form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() == 3


def test_engine(spark, docs):
    records = spark.createDataFrame([(1, "Central bank", "u", "s")], "doc_id long, title string, url string, source string")
    engine = SearchEngine(spark, docs, records)
    assert engine.validate("bank%20AND%20rates") and not engine.validate("bank NOT rates")
    first = engine.answer("tfidf", "banks", 1, 2)
    assert first["total_pages"] == 2 and first["rows"][0]["rank"] == 1 and engine.answer("tfidf", "banks", 1, 2) is first
    assert [r["doc_id"] for r in engine.answer("boolean", "NOT banks", 1, 10)["rows"]] == [4, 5, 6]
    assert engine.page(engine.boolean("bank"), 7, 10).count() == 0 and engine.bm25("bank").count() == 3
    assert engine.spellcheck("bnak") in ("bank", "bnak")


def test_cache():
    now = [0.0]
    cache = ResultCache(10, 2, lambda: now[0])
    cache.set(("a",), 1)
    now[0] = 8
    assert cache.get(("a",)) == 1
    now[0] = 17
    assert cache.get(("a",)) == 1
    now[0] = 40
    assert cache.get(("a",)) is None


def test_store(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    store = IndexStore.build(spark, docs.where("doc_id < 4"), path, stemming=False)
    newer = store.updated(None, docs.where("doc_id >= 4"), stemming=False)
    whole = build_postings(docs)
    rows = lambda df: sorted((r.term, r.doc_id, tuple(r.positions)) for r in df.collect())
    assert rows(newer.postings) == rows(whole) and IndexStore.versions(spark, path) == [1, 2]
    assert store.meta[0] == 3 and IndexStore.open(spark, path).meta[0] == docs.count()
    assert newer.frequencies(["bank", "zzz"]) == {"bank": whole.where("term = 'bank'").count(), "zzz": 0}
    plain, kept = SearchEngine(spark, docs, stemming=False), SearchEngine(spark, docs, stemming=False, store=newer)
    for text in ("bank rates", "bank bank zzz", "zzz", ""):
        assert {(r.doc_id, r.score) for r in plain.tfidf(text).collect()} == {(r.doc_id, r.score) for r in kept.tfidf(text).collect()}
    assert plain.bm25("bank rates").collect() == kept.bm25("bank rates").collect()
    assert plain.bm25("the bank", stop_words=frozenset({"the"})).count() == plain.bm25("bank").count()
    assert kept.spellcheck("bnak") == plain.spellcheck("bnak")
    with pytest.raises(FileNotFoundError):
        IndexStore.open(spark, str(tmp_path / "none"))


def test_boolean_batch(spark, docs):
    rows = build_postings(docs)
    asked = [("a", "bank AND rates"), ("b", "NOT bank"), ("c", "bank NOT rates"), ("d", "zzz"), ("a", "bank AND rates"), ("e", "")]
    got = {(r.query_id, r.doc_id) for r in boolean.search_batch(rows, docs, asked).collect()}
    assert got == {(i, r.doc_id) for i, q in asked for r in boolean.search(rows, docs, q).collect()}
    assert boolean.search_batch(rows, docs, [("x", "AND AND")]).count() == 0


def test_pages_around_are_remembered(spark, docs):
    engine = SearchEngine(spark, docs, stemming=False)
    asked = []
    find = engine.boolean
    engine.boolean = lambda q: asked.append(q) or find(q)
    pages = [engine.answer("boolean", "NOT zzz", n, 2) for n in (1, 2, 3)]
    assert asked == ["NOT zzz"] and [r["doc_id"] for p in pages for r in p["rows"]] == sorted(r.doc_id for r in docs.collect())[:6]
    assert [r["rank"] for p in pages for r in p["rows"]] == list(range(1, 7)) and engine.answer("boolean", "NOT zzz", 40, 2)["rows"] == []


def test_frequency_cache():
    cache = FrequencyCache(2)
    cache.set("a", 1)
    cache.set("b", 2)
    assert cache.get("a") == 1 and cache.get("z") is None
    cache.set("c", 3)
    assert cache.get("b") is None and cache.get("a") == 1 and cache.get("c") == 3
    cache.set("a", 5)
    assert cache.get("a") == 5


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{}", {}), ("{'a': 'b'}", {"a": "b"}), ("{'it's': 'x's y'}", {"it's": "x's y"}), ("{'a': \"b's\", 'c': 'd'}", {"a": "b's", "c": "d"}), ("{'a': 'b', 'a': 'c'}", {"a": "c"}),
        ("{, 'a': 'b'}", None), ("{'a': }", None), ("", None), (None, None), ("{'a': 'b'", None), ("{'a': 'x, y: z'}", {"a": "x, y: z"}),
    ],
)
def test_decoded_map(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(ingest.decoded_map(F.col("t")).alias("m")).first().m == want


def test_records_and_sources(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "doc_id long, title string, summary string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "e")], "doc_id long, title string")
    assert {tuple(r) for r in ingest.merged_records(old, new).collect()} == {(1, "a", "s"), (2, "c", None), (3, "d", None)}
    values = spark.createDataFrame([(1, "z", 1), (1, "y", 2), (2, None, 3)], "doc_id long, summary string, at int")
    assert {(r.doc_id, r.summary) for r in ingest.upserted(old, values, "summary", "at").collect()} == {(1, "y"), (2, "s")}
    (tmp_path / "words.txt").write_text("Bank 12\nriver\n\nnew york 3\n")
    assert {tuple(r) for r in files.load_words(spark, str(tmp_path / "words.txt")).collect()} == {("bank", 12), ("river", 1), ("new york", 3)}
    rows = spark.createDataFrame([(i, "bbc" if i % 2 else "ind", f"t{i}", f" l1\nl2 \"q\" {i} ", datetime.date(2024, 1, 1 + i % 3), i % 2) for i in range(9)], "doc_id long, source string, title string, content string, crawl_date date, frag_index int")
    files.write_named_fragments(rows, str(tmp_path / "fragments"))
    back = files.read_fragments(spark, str(tmp_path / "fragments")).select(rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    files.push_fragments(spark, str(tmp_path / "fragments"), str(tmp_path / "table"), [("bbc", "2024-01-02"), ("zzz", "2024-01-02")])
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 7]
    files.clear(spark, str(tmp_path / "table"))
    files.clear(spark, str(tmp_path / "table"))
    assert not (tmp_path / "table").exists()
    model = expansion.train(spark.createDataFrame([("bank river bank water",)] * 5, "text string"), size=4)
    expansion.saved(model, str(tmp_path / "model"))
    assert expansion.loaded(str(tmp_path / "model")).getVectors().count() == model.getVectors().count()


def test_synonyms_and_contexts(spark):
    assert suggest.split_synonyms({"bank": ["banks", "lender"], "uk": ["united kingdom"]}) == ({"bank": ["lender"], "uk": ["united kingdom"]}, {"bank": ["banks"]})
    assert suggest.flat_tokens([["a b", "c"], ["b"]]) == ["a", "b", "c"]


def test_filtered_corpus_beyond_the_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "the " * 50 + f"word{i % 7} rare{i}") for i in range(40)] + [(99, None)], "doc_id long, text string")
    want = {tuple(r) for r in corpus.filtered_corpus(rows, corpus.vocabulary(rows), 3).collect()}
    monkeypatch.setattr(corpus, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(corpus, "HOT_SHARE", 0.5)
    assert {tuple(r) for r in corpus.filtered_corpus(rows, corpus.vocabulary(rows), 3).collect()} == want


def test_stream(spark, tmp_path):
    schema = "doc_id long, url string, title string, date string, content string, source string"
    rows = [(i, f"https://www.s.example/news/x/{i % 4}", f"title {i}", "2024", "bank rates", "s") for i in range(6)]
    frame = spark.createDataFrame(rows, schema)
    frame.limit(3).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    source = lambda: stream.read_stream(spark, str(tmp_path / "in" / "*"), frame.schema)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream.ingest(source(), out, checkpoint).awaitTermination()
    frame.coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream.ingest(source(), out, checkpoint).awaitTermination()
    urls = [r.url for r in spark.read.parquet(f"{out}/records").collect()]
    assert sorted(urls) == sorted({r[1] for r in rows})
    assert spark.read.parquet(f"{out}/postings").where("term = 'bank'").count() == 4


def test_pipeline(spark, tmp_path):
    from loomsearch.plans import pipeline

    body = "<h1>Bank rates</h1>" + "".join(f"<p>Line {i} of the bank. It rose.</p>" for i in range(5))
    pages = spark.createDataFrame([("https://www.s.example/news/uk/a/x", body, "2024-01-01", 1), ("https://www.s.example/news/uk/a/x", body, "2024-01-02", 2), ("https://www.s.example/b", None, None, None), ("old", body, "", 0), (None, body, "", 0)], "url string, html string, date string, fetched_at int")
    day = pipeline.run(pages, spark.createDataFrame([("old",), (None,)], "url string"), 7, stemming=False)
    records = {r.url: r for r in day.records.collect()}
    assert sorted(r.doc_id for r in records.values()) == [7, 8]
    first = records["https://www.s.example/news/uk/a/x"]
    assert first.topic == "news-uk" and first.source == "s" and first.summary and first.sentiment.startswith('["negative:')
    assert records["https://www.s.example/b"].summary == enrich.DEFAULT_SUMMARY
    pipeline.write(day, str(tmp_path), "1")
    assert spark.read.parquet(f"{tmp_path}/postings").where("term = 'bank'").count() == 1


def test_registered_queries_have_statements():
    from loomsearch import registry

    assert registry.oracle_sql().keys() <= registry.queries().keys() and len(registry.oracle_sql()) > 80


def test_word_vectors_dont_pass_the_driver(spark):
    # 20,000 words of 200 numbers are 16 MB: nothing of that size is collected
    words = [f"{'bank river market'.split()[i % 3]} word{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(" ".join(words[i : i + 50]),) for i in range(0, len(words), 50)], "text string").repartition(4)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "4m")
    try:
        model = expansion.train(docs)
        query, added = expansion.expanded(model, "bank nowhere")
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert model.getVectors().count() == 20_003
    assert query.split()[:2] == ["bank", added[0]] and len(added) <= 3 and "nowhere" in query


def test_word_vectors_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("sea", "tax")]
    texts = [" ".join(rng.choices(topics[n % 2], k=40)) for n in range(600)]
    docs = spark.createDataFrame([(t,) for t in [*texts, "unique", None, "", "the of"]], "text string")
    for words, vocabulary, partitions in ((4_000_000, 100_000, 1), (9_000, 100_000, 2), (4_000_000, 20, 3)):
        monkeypatch.setattr(expansion, "PART_WORDS", words)
        monkeypatch.setattr(expansion, "PART_VOCABULARY", vocabulary)
        model = expansion.train(docs, size=16, window=5, partitions=partitions, iterations=5)
        assert sorted(r.word for r in model.getVectors().collect()) == sorted([*topics[0], *topics[1], "unique"])
        near = model.synonyms(["sea3", "tax5", "nowhere"], 5)
        assert near.keys() == {"sea3", "tax5"} and all(len(x) == 5 and w not in x and {y[:3] for y in x} == {w[:3]} for w, x in near.items()), near
    assert "unique" not in {r.word for r in expansion.train(docs, size=8, min_count=2).getVectors().collect()}
    assert [r.words for r in expansion._frequent(spark.createDataFrame([(["b", "a", "c", "b"],), (["c"],)], "words array<string>"), 2).orderBy(F.size("words")).collect()] == [["c"], ["b", "c", "b"]]


def test_nearest_words_are_those_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"w{i:03}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(f"v{i}", rows[7][1]) for i in range(3)]
    model = expansion.WordVectors(spark.createDataFrame(rows, "word string, vector array<float>").repartition(5))
    vectors = {w: [x / sum(y * y for y in v) ** 0.5 for x in v] for w, v in rows}
    for n in (1, 4, 500):
        want = sorted((w for w in vectors if w != "w007"), key=lambda w: (-round(sum(a * b for a, b in zip(vectors[w], vectors["w007"], strict=True)), 5), w))[:n]
        got = model.synonyms(["w007"], n)["w007"]
        assert got[: min(n, 4)] == want[: min(n, 4)] and set(got) == set(want)
