"""The registered queries of the search core, each over its whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import html, stem, text, vectors
from .functions.text import STOP_WORDS
from .operators import boolean, corpus, enrich, expansion, ingest, postings, ranked, results, spelling, suggest
from .plans import pipeline
from .plans import query as language
from .plans.engine import SearchEngine
from .plans.store import IndexStore
from .shared import scratch
from .shipping import ship
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return files.read_table(ship(spark), d, name)


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its statement if there is one."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return add


_STOP = ", ".join(f"('{w}')" for w in sorted(STOP_WORDS))
_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(STOP_WORDS)) + "]"
_TOKENS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '[a-z0-9]'))"
#: all(doc_id, t), tok(doc_id, t) with and without stop words; pos(doc_id, term, p); post(term, doc_id, tf, positions).
_BASE = rf"""
WITH alltok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
tok AS (SELECT doc_id, list_filter(t, lambda x: NOT list_contains({_STOP_LIST}, x)) AS t FROM alltok),
pos AS (SELECT doc_id, unnest(t) AS term, unnest(generate_series(1, len(t))) AS p FROM tok),
post AS (SELECT term, doc_id, count(*) AS tf, list(p ORDER BY p) AS positions FROM pos GROUP BY term, doc_id),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents)
"""


def _day_sql(column: str) -> str:
    """The date of a text in any of the forms that occur."""
    t = f"trim({column}, ' ')"
    forms = {
        r"^\d{4}/\d{2}/\d{2}$": "%Y/%m/%d", r"^\d{2}/\d{2}/\d{4}$": "%d/%m/%Y", r"^\d{1,2} [A-Za-z]{3} \d{4}$": "%d %b %Y", r"^\d{1,2} [A-Za-z]+ \d{4}$": "%d %B %Y",
        r"^[A-Za-z]+ \d{1,2}, \d{4}$": "%B %d, %Y", r"^\d{8}$": "%Y%m%d", r"^\d{2}\.\d{2}\.\d{4}$": "%d.%m.%Y",
    }
    cases = " ".join(f"WHEN regexp_matches({t}, '{pattern}') THEN try_strptime({t}, '{form}')" for pattern, form in forms.items())
    return rf"CAST(CASE WHEN regexp_matches({t}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN try_strptime(substr({t}, 1, 10), '%Y-%m-%d') {cases} END AS DATE)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def _index(spark: SparkSession, d: str, terms: list[str] | None = None) -> DataFrame:
    return postings.build_postings(_documents(spark, d), terms=terms)


def _size(docs: DataFrame) -> int:
    return docs.select("doc_id").distinct().count()


# --- text analysis -------------------------------------------------------------------------------------------------


@query(_BASE + "SELECT doc_id, len(t) AS n_tokens FROM alltok")
def tokenize_counts(spark, d):
    return _documents(spark, d).select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(_BASE + ", w AS (SELECT unnest(t) AS word FROM alltok) SELECT word, count(*) AS count FROM w GROUP BY word")
def vocab_counts(spark, d):
    return corpus.vocabulary(_documents(spark, d))


@query(_BASE + "SELECT doc_id, len(t) AS n_tokens FROM tok")
def stopword_filtered_counts(spark, d):
    return _documents(spark, d).select("doc_id", F.size(text.analysed(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS n_tokens FROM documents")
def alpha_token_counts(spark, d):
    return _documents(spark, d).select("doc_id", F.size(text.alpha_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"SELECT doc_id, regexp_replace(title, '[^\p{L}\p{N}_\s]', ' ', 'g') AS plain, trim(regexp_replace(regexp_replace(title, '[’”“]', ' ', 'g'), '\s+', ' ', 'g')) AS clean, trim(regexp_replace(title, '[(\s\p{Z}\x{85}\x{1c}-\x{1f}+)\t\"'']+', ' ', 'g')) AS markup FROM articles")
def cleaned_titles(spark, d):
    t = F.col("title")
    return read(spark, d, "articles").select("doc_id", text.non_words_to_space(t).alias("plain"), text.clean_sentence_text(t).alias("clean"), text.clean_markup_text(t).alias("markup"))


@query(r"SELECT doc_id, len(regexp_split_to_array(content, '[.!?]')) AS n_segments FROM articles WHERE content IS NOT NULL")
def sentence_split_counts(spark, d):
    return read(spark, d, "articles").where("content is not null").select("doc_id", F.size(text.segments(F.col("content"))).cast("long").alias("n_segments"))


@query(
    r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(content, ''), '[’”“]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM articles)
SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS INTEGER) AS n_sentences FROM c"""
)
def sentence_counts(spark, d):
    return read(spark, d, "articles").select("doc_id", F.size(text.sentences(F.col("content"))).alias("n_sentences"))


@query(
    r"""
WITH k AS (SELECT doc_id, regexp_replace(lower(substr(coalesce(title, ''), 1, 40)), '[^a-z0-9 :_\-]', '', 'g') AS k FROM articles),
a AS (SELECT doc_id, regexp_replace(regexp_replace(replace(k, '-', ' '), '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g') AS s, trim(regexp_replace(k, '-+', '-', 'g')) AS plain FROM k)
SELECT doc_id, trim(regexp_replace(s, ' +', ' ', 'g')) AS node, plain FROM a
"""
)
def node_names(spark, d):
    return read(spark, d, "articles").select("doc_id", text.node_name(F.col("title")).alias("node"), text.plain_word(F.col("title")).alias("plain"))


@query(
    r"""
SELECT doc_id, string_split(url, '.')[2] AS source, array_to_string(list_slice(list_slice(string_split(url, '/'), 4, len(string_split(url, '/')) - 1), 1, 2), '-') AS topic,
 array_to_string(list_slice(string_split(url, '/'), 4, len(string_split(url, '/')) - 1), '-') AS full_topic, string_split(url, '/')[3] AS host FROM articles WHERE url IS NOT NULL
"""
)
def url_parts(spark, d):
    u = F.col("url")
    rows = read(spark, d, "articles").where("url is not null")
    return rows.select("doc_id", text.url_source(u).alias("source"), text.url_topic(u).alias("topic"), text.url_topic(u, None).alias("full_topic"), text.url_host(u).alias("host"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(content, '.'), 1, 3), '.') AS summary FROM articles")
def lead3_summary(spark, d):
    return read(spark, d, "articles").select("doc_id", text.lead(F.col("content")).alias("summary"))


@query("SELECT loc, lastmod, TRY_CAST(try_strptime(substr(lastmod, 1, 10), '%Y-%m-%d') AS DATE) AS day, coalesce(regexp_extract(lastmod, '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS found FROM sitemap_links WHERE lastmod IS NOT NULL".replace("\\\\", "\\"))
def link_dates(spark, d):
    m = F.col("lastmod")
    return read(spark, d, "sitemap_links").where("lastmod is not null").select("loc", "lastmod", text.day(m).alias("day"), text.found_day(m).alias("found"))


@query("SELECT doc_id, date, " + _day_sql("date") + " AS day FROM articles")
def parsed_dates(spark, d):
    """Dates in all the forms that occur."""
    return read(spark, d, "articles").select("doc_id", "date", text.any_day(F.col("date")).alias("day"))


@query(
    r"""
WITH q AS (SELECT doc_id, replace(title, ' ', '%20') AS t FROM articles)
SELECT doc_id, CASE WHEN NOT regexp_matches(t, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)') THEN url_decode(replace(t, '+', '%20')) END AS title FROM q"""
)
def decoded_queries(spark, d):
    """Titles as they come in a request, decoded; null where an escape is broken."""
    return read(spark, d, "articles").select("doc_id", text.decoded_url(F.regexp_replace("title", " ", "%20")).alias("title"))


# --- index ---------------------------------------------------------------------------------------------------------


@query(_BASE + "SELECT term, doc_id, CAST(tf AS INTEGER) AS tf, array_to_string(positions, ',') AS positions FROM post")
def postings_positions(spark, d):
    return _index(spark, d).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(_BASE + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def term_df(spark, d):
    return postings.term_stats(_index(spark, d))


@query(_BASE + "SELECT term, doc_id, CAST(tf AS INTEGER) AS tf FROM post")
def tf_index(spark, d):
    return _index(spark, d).select("term", "doc_id", "tf")


@query(_BASE + "SELECT doc_id, CAST(len(t) AS INTEGER) AS dl FROM tok")
def doc_lengths(spark, d):
    return postings.doc_lengths(_documents(spark, d))


@query("SELECT count(DISTINCT doc_id) AS document_size, min(doc_id) AS min_doc_id, max(doc_id) AS max_doc_id FROM documents")
def index_meta(spark, d):
    return postings.index_meta(_documents(spark, d))


@query()
def stemmed_index(spark, d):
    return postings.build_postings(_documents(spark, d), stemming=True).select("term", "doc_id", "tf")


@query()
def stems(spark, d):
    return stem.stem_table(corpus.vocabulary(_documents(spark, d)).select(F.col("word").alias("term")))


_CLEAN = """
WITH rows AS (SELECT lower(trim(term, ' ')) AS term, doc_id, positions FROM index_postings WHERE term IS NOT NULL AND doc_id IS NOT NULL),
clean AS (SELECT term, doc_id, list_sort(list_distinct(flatten(list(positions)))) AS positions FROM rows GROUP BY term, doc_id)
"""


@query(_CLEAN + "SELECT term, doc_id, CAST(len(positions) AS INTEGER) AS tf, array_to_string(positions, ',') AS positions FROM clean")
def clean_postings(spark, d):
    rows = postings.clean_postings(read(spark, d, "index_postings"))
    return rows.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def _halves(spark, d):
    rows = postings.clean_postings(read(spark, d, "index_postings"))
    old = rows.where("doc_id % 3 != 0")
    new = rows.where("doc_id % 3 != 1").withColumn("positions", F.transform("positions", lambda p: p + 1))
    return old, new


_MERGE = _CLEAN + """, a AS (SELECT term, doc_id, positions FROM clean WHERE doc_id % 3 <> 0),
b AS (SELECT term, doc_id, list_transform(positions, lambda p: p + 1) AS positions FROM clean WHERE doc_id % 3 <> 1),
m AS (SELECT term, doc_id, a.positions AS pa, b.positions AS pb FROM a FULL JOIN b USING (term, doc_id))
"""


@query(_MERGE + "SELECT term, doc_id, array_to_string(coalesce(pa, pb), ',') AS positions FROM m")
def merge_keep_first(spark, d):
    """Two overlapping indices in one, the older posting kept."""
    return postings.merged(*_halves(spark, d), "first").select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(_MERGE + "SELECT term, doc_id, array_to_string(coalesce(pb, pa), ',') AS positions FROM m")
def merge_keep_last(spark, d):
    return postings.merged(*_halves(spark, d), "last").select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(_CLEAN + "SELECT term, doc_id, array_to_string(list_transform(positions, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - positions[i - 1] END), ',') AS positions FROM clean")
def delta_encode(spark, d):
    rows = postings.encoded(postings.clean_postings(read(spark, d, "index_postings")))
    return rows.select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(_CLEAN + "SELECT term, doc_id, array_to_string(positions, ',') AS positions FROM clean")
def delta_round_trip(spark, d):
    rows = postings.decoded(postings.encoded(postings.clean_postings(read(spark, d, "index_postings"))))
    return rows.select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(_CLEAN + r"""SELECT term, concat_ws(chr(10), term || ' ' || count(*), string_agg(chr(9) || doc_id || ': ' || array_to_string(positions, ','), chr(10) ORDER BY doc_id)) AS line FROM clean GROUP BY term""")
def index_text(spark, d):
    """The index in its text form."""
    return postings.index_lines(postings.clean_postings(read(spark, d, "index_postings")))


@query(_CLEAN + ", x AS (SELECT term, doc_id FROM clean WHERE term IN ('council', 'bridge')) SELECT term, count(*) AS df FROM x GROUP BY term")
def term_lookup(spark, d):
    """Point lookup of terms in a written index: the filter reaches the scan."""
    path = scratch(spark, "index")
    postings.write_postings(postings.clean_postings(read(spark, d, "index_postings")), path)
    return spark.read.parquet(path).where(F.col("term").isin("council", "bridge")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


# --- boolean retrieval ---------------------------------------------------------------------------------------------


def _boolean(name: str, text_: str, sql: str):
    @query(_BASE + sql, name)
    def run(spark, d, q=text_):
        docs = _documents(spark, d)
        tree = language.parse(q, stemming=False)
        return boolean.search(_index(spark, d, language.terms(tree)), docs, q, stemming=False)


def _has(word: str) -> str:
    return f"SELECT doc_id FROM post WHERE term = '{word}'"


_boolean("bool_word", "council", _has("council"))
_boolean("bool_and", "council AND bridge", f"({_has('council')}) INTERSECT ({_has('bridge')})")
_boolean("bool_or", "council OR bridge", f"({_has('council')}) UNION ({_has('bridge')})")
_boolean("bool_not", "NOT council", f"SELECT DISTINCT doc_id FROM documents EXCEPT ({_has('council')})")
_boolean("bool_and_not", "council AND NOT bridge", f"({_has('council')}) EXCEPT ({_has('bridge')})")
_boolean("bool_parens", "(council OR bridge) AND NOT (market OR union)", f"(({_has('council')}) UNION ({_has('bridge')})) EXCEPT (({_has('market')}) UNION ({_has('union')}))")
_boolean("bool_equal_precedence", "council OR bridge AND market", f"(({_has('council')}) UNION ({_has('bridge')})) INTERSECT ({_has('market')})")
_boolean("bool_adjacent_operands", "council bridge", _has("bridge"))
_boolean("bool_unknown_term", "council OR zzzunknownzzz", _has("council"))
_boolean("bool_not_unknown", "NOT zzzunknownzzz", "SELECT DISTINCT doc_id FROM documents")
_boolean("bool_double_not", "council AND NOT NOT bridge", f"({_has('council')}) INTERSECT ({_has('bridge')})")


def _phrase_sql(*words: str) -> str:
    joins = " ".join(f"JOIN pos p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.p = p0.p + {i} AND p{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"SELECT DISTINCT p0.doc_id FROM pos p0 {joins} WHERE p0.term = '{words[0]}'"


def _near_sql(n: int, a: str, b: str) -> str:
    return f"SELECT DISTINCT x.doc_id FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND abs(x.p - y.p) <= {n} WHERE x.term = '{a}' AND y.term = '{b}'"


_boolean("phrase_two", '"clear council"', _phrase_sql("clear", "council"))
_boolean("phrase_three", '"according council board"', _phrase_sql("according", "council", "board"))
_boolean("phrase_over_stop_word", '"critics of the council"', _phrase_sql("critics", "council"))
_boolean("phrase_one_word", '"council"', _has("council"))
_boolean("proximity_3", "#3(council, approved)", _near_sql(3, "council", "approved"))
_boolean("proximity_same_word", "#0(council, council)", _near_sql(0, "council", "council"))
_boolean("proximity_or_phrase", '#5(council, bridge) OR "clear council"', f"({_near_sql(5, 'council', 'bridge')}) UNION ({_phrase_sql('clear', 'council')})")
_boolean("bool_mixed", '"clear council" AND (NOT bridge OR #5(council, bridge))', f"({_phrase_sql('clear', 'council')}) INTERSECT ((SELECT doc_id FROM documents EXCEPT ({_has('bridge')})) UNION ({_near_sql(5, 'council', 'bridge')}))")


@query(_BASE + _phrase_sql("clear", "council"))
def phrase_join(spark, d):
    """A phrase by joining position rows."""
    return ranked.phrase_joined(_index(spark, d, ["clear", "council"]), ["clear", "council"])


@query(_BASE + f"(({_has('council')}) INTERSECT ({_has('bridge')})) UNION (SELECT doc_id FROM documents EXCEPT ({_has('council')}))")
def set_operations(spark, d):
    """AND, OR and NOT over sets that are tables of their own."""
    docs, rows = _documents(spark, d), _index(spark, d, ["council", "bridge"])
    a, b = (rows.where(F.col("term") == w).select("doc_id") for w in ("council", "bridge"))
    both = boolean.set_operation("AND", a, b)
    return boolean.set_operation("OR", both, boolean.set_operation("NOT", a, universe=docs))


@query(
    """SELECT * FROM (VALUES ('a AND b', true), ('a NOT b', false), ('a AND NOT b', true), ('NOT NOT a', true), ('AND a', true), ('a OR', true), ('a AND OR b', false),
 ('(a OR b', false), ('a) b', false), ('()', true), ('(a) b', false), ('a b', true), ('( AND a)', false), ('', true), ('#2(a, b) AND "c d"', true)) AS t(query, valid)"""
)
def validated_queries(spark, d):
    texts = ["a AND b", "a NOT b", "a AND NOT b", "NOT NOT a", "AND a", "a OR", "a AND OR b", "(a OR b", "a) b", "()", "(a) b", "a b", "( AND a)", "", '#2(a, b) AND "c d"']
    return spark.createDataFrame([(t, language.check(t, stopping=False, stemming=False)) for t in texts], "query string, valid boolean")


# --- ranked retrieval ----------------------------------------------------------------------------------------------


def _tfidf_sql(words: dict[str, int]) -> str:
    rows = ", ".join(f"('{w}', {n})" for w, n in words.items())
    return (
        _BASE
        + f""", q AS (SELECT * FROM (VALUES {rows}) AS t(term, qtf)), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
score AS (SELECT doc_id, round(sum(qtf * (1 + log10(tf)) * log10(CAST((SELECT n FROM n) AS DOUBLE) / df)), 6) AS score FROM post JOIN q USING (term) JOIN df USING (term) GROUP BY doc_id)
"""
    )


def _tfidf(spark, d, q: str) -> DataFrame:
    docs = _documents(spark, d)
    scored = ranked.tfidf(_index(spark, d, sorted(ranked.query_terms(q))), q, _size(docs))
    return scored.withColumn("score", F.round("score", 6))


@query(_tfidf_sql({"council": 1}) + "SELECT doc_id, score FROM score")
def tfidf_single(spark, d):
    return _tfidf(spark, d, "council")


@query(_tfidf_sql({"council": 1, "bridge": 1, "market": 1}) + "SELECT doc_id, score FROM score")
def tfidf_multi(spark, d):
    return _tfidf(spark, d, "the council and the bridge market")


@query(_tfidf_sql({"council": 2, "bridge": 1}) + "SELECT doc_id, score FROM score")
def tfidf_duplicate_terms(spark, d):
    return _tfidf(spark, d, "council bridge council")


@query(_tfidf_sql({"council": 1}) + "SELECT doc_id, score FROM score")
def tfidf_oov(spark, d):
    return _tfidf(spark, d, "council zzzunknownzzz")


_TOP = "SELECT doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank "


@query(_tfidf_sql({"council": 1, "bridge": 1}) + _TOP + "<= 10")
def tfidf_top10(spark, d):
    return ranked.top(_tfidf(spark, d, "council bridge"), 10)


@query(_tfidf_sql({"council": 1, "bridge": 1}) + _TOP + "BETWEEN 11 AND 20")
def tfidf_page2(spark, d):
    return results.page(_tfidf(spark, d, "council bridge"), 2, 10, [F.desc("score"), F.asc("doc_id")])


@query(_tfidf_sql({"council": 1, "bridge": 1}) + "SELECT doc_id, score, CAST((rank - 1) // 10 + 1 AS INTEGER) AS page FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 50")
def page_window(spark, d):
    """The pages within four of page 1."""
    found = _tfidf(spark, d, "council bridge").persist()
    return results.page_window(found, 1, 10, found.count(), [F.desc("score"), F.asc("doc_id")])


_BATCH = [("q1", "council bridge"), ("q2", "market union council"), ("q3", "approved report")]


@query(
    _BASE
    + """, q AS (SELECT * FROM (VALUES ('q1', 'council'), ('q1', 'bridge'), ('q2', 'market'), ('q2', 'union'), ('q2', 'council'), ('q3', 'approved'), ('q3', 'report')) AS t(query_id, term)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum((1 + log10(tf)) * log10(CAST((SELECT n FROM n) AS DOUBLE) / df)), 6) AS score FROM post JOIN q USING (term) JOIN df USING (term) GROUP BY query_id, doc_id),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def tfidf_batch(spark, d):
    """Several queries in one plan."""
    docs = _documents(spark, d)
    terms = sorted({t for _, q in _BATCH for t in ranked.query_terms(q)})
    return ranked.top_per_query(ranked.tfidf_batch(_index(spark, d, terms), _BATCH, _size(docs)), 5)


_BM25 = r"""
WITH tok AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS t FROM documents),
pos AS (SELECT doc_id, source, unnest(t) AS term FROM tok),
post AS (SELECT term, doc_id, any_value(source) AS source, count(*) AS tf FROM pos WHERE term IN ('council', 'bridge') GROUP BY term, doc_id),
len AS (SELECT doc_id, len(t) AS dl FROM tok), a AS (SELECT avg(dl) AS avgdl FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
score AS (SELECT doc_id, any_value(source) AS source, round(sum(log10(CAST((SELECT n FROM n) AS DOUBLE) / df) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM a)))), 6) AS score FROM post JOIN df USING (term) JOIN len USING (doc_id) GROUP BY doc_id)
"""


def _bm25(spark, d, included=None):
    docs = _documents(spark, d)
    return ranked.bm25(postings.letter_postings(docs, ["council", "bridge"]), postings.doc_lengths(docs, letters_only=True), "Council bridge", _size(docs), included=included)


@query(_BM25 + _TOP + "<= 10")
def bm25_top10(spark, d):
    return ranked.top(_bm25(spark, d), 10)


@query(_BM25 + "SELECT doc_id, score FROM score WHERE source = 'harrowpost'")
def bm25_filtered(spark, d):
    """BM25 among included documents only; document frequencies stay those of all."""
    included = _documents(spark, d).where("source = 'harrowpost'")
    return _bm25(spark, d, included).withColumn("score", F.round("score", 6))


@query(
    """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT v FROM q) AS DOUBLE[])), 6) AS sim FROM embeddings)
SELECT vec_id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
)
def dense_topk(spark, d):
    rows = read(spark, d, "embeddings")
    vector = rows.where("vec_id = 0").select("embedding").first()[0]
    return ranked.dense_top(rows, vector, 10)


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS sim FROM embeddings")
def vector_cosine(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("sim"))


@query()
def stemmed_tfidf(spark, d):
    docs = _documents(spark, d)
    return ranked.tfidf(postings.build_postings(docs, stemming=True), "councils bridges", _size(docs), stemming=True).withColumn("score", F.round("score", 6))


# --- results -------------------------------------------------------------------------------------------------------

_RECORDS = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC NULLS LAST, length(summary) DESC NULLS LAST, summary ASC NULLS LAST, sentiment ASC NULLS LAST, title ASC NULLS LAST) AS k FROM doc_records WHERE doc_id IS NOT NULL),
rec AS (SELECT * FROM r WHERE k = 1)
"""


def _records(spark, d):
    return results.document_records(read(spark, d, "doc_records"))


@query(_RECORDS + "SELECT doc_id, url, title, date, sentiment, summary, source, topic FROM rec")
def document_records(spark, d):
    """The latest version of each document record."""
    return _records(spark, d).select("doc_id", "url", "title", "date", "sentiment", "summary", "source", "topic")


@query(
    _RECORDS.rstrip()
    + """, c AS (SELECT lower(trim(term, ' ')) AS term, doc_id FROM index_postings WHERE term IS NOT NULL), hit AS (SELECT DISTINCT doc_id FROM c WHERE term = 'council'),
p AS (SELECT doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM hit) WHERE rank BETWEEN 11 AND 20)
SELECT p.doc_id, p.rank, rec.title, rec.topic, rec.url, rec.source FROM p LEFT JOIN rec USING (doc_id)"""
)
def page_enriched(spark, d):
    """The second page of a boolean query with the fields of its documents."""
    rows = postings.clean_postings(read(spark, d, "index_postings").where(F.lower(F.trim("term")) == "council"))
    found = boolean.search(rows, rows, "council", stemming=False)
    return results.enriched(results.page(found, 2, 10, [F.asc("doc_id")]), _records(spark, d), ["title", "topic", "url", "source"])


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def facet_sources(spark, d):
    return results.facet(_documents(spark, d))


@query("SELECT doc_id, source FROM documents WHERE source = 'harrowpost'")
def filter_source(spark, d):
    return results.of_source(_documents(spark, d), "harrowpost").select("doc_id", "source")


@query("SELECT doc_id, date FROM articles WHERE year(" + _day_sql("date") + ") = 2023")
def filter_year(spark, d):
    """Articles of 2023, whatever the form of their date."""
    return results.in_year(read(spark, d, "articles"), 2023, F.col("date")).select("doc_id", "date")


_PARTS = (
    _RECORDS.rstrip()
    + """, e AS (SELECT doc_id, unnest(CAST(TRY_CAST(sentiment AS JSON) AS VARCHAR[])) AS e FROM rec WHERE sentiment IS NOT NULL),
s AS (SELECT doc_id, string_split(e, ':')[1] AS label, coalesce(TRY_CAST(string_split(e, ':')[2] AS DOUBLE), 0.0) AS v FROM e),
x AS (SELECT rec.doc_id, coalesce(sum(v) FILTER (label = 'negative'), 0.0) AS negative, coalesce(sum(v) FILTER (label = 'neutral'), 0.0) AS neutral, coalesce(sum(v) FILTER (label = 'positive'), 0.0) AS positive FROM rec LEFT JOIN s USING (doc_id) GROUP BY rec.doc_id)
"""
)


@query(_PARTS + "SELECT doc_id, round(negative, 6) AS negative, round(neutral, 6) AS neutral, round(positive, 6) AS positive FROM x")
def sentiment_parts(spark, d):
    rows = _records(spark, d).select("doc_id", results.sentiment_parts(F.col("sentiment")).alias("s"))
    return rows.select("doc_id", *[F.round(f"s.{k}", 6).alias(k) for k in ("negative", "neutral", "positive")])


@query(_PARTS + "SELECT doc_id FROM x WHERE positive > neutral AND positive > negative")
def sentiment_argmax(spark, d):
    """Records whose sentiment is mostly positive."""
    rows = _records(spark, d).withColumn("s", results.sentiment_parts(F.col("sentiment")))
    return results.with_sentiment(rows, "positive", F.col("s")).select("doc_id")


# --- corpus and assistance -----------------------------------------------------------------------------------------

_LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT regexp_extract_all(lower(line), '[\p{L}\p{N}_]+') AS t FROM l),
b AS (SELECT unnest(list_zip(list_slice(t, 1, len(t) - 1), list_slice(t, 2, len(t)))) AS z FROM w WHERE len(t) > 1),
big AS (SELECT z[1] AS first, z[2] AS second, count(*) AS count FROM b GROUP BY 1, 2)
"""


@query(_LINES + "SELECT first, second, count FROM big")
def bigram_counts(spark, d):
    return corpus.bigram_counts(_documents(spark, d))


@query(_LINES + "SELECT first, second, count FROM big ORDER BY count DESC, first, second LIMIT 50")
def bigrams_top(spark, d):
    return corpus.bigram_counts(_documents(spark, d)).orderBy(F.desc("count"), "first", "second").limit(50)


@query(
    _LINES.rstrip()
    + rf""", v AS (SELECT unnest({_TOKENS}) AS word FROM documents), vc AS (SELECT word, count(*) AS c FROM v GROUP BY word),
mono AS (SELECT word AS text, CAST(trunc(c / 10) AS BIGINT) AS count FROM vc WHERE length(word) > 3 AND c > 7 AND NOT list_contains({_STOP_LIST}, word))
SELECT text, count, 'monogram' AS kind FROM mono UNION ALL
SELECT first || ' ' || second, count, 'bigram' FROM big WHERE count > 1 AND first IN (SELECT text FROM mono) AND second IN (SELECT text FROM mono)"""
)
def suggest_dictionary(spark, d):
    return corpus.suggestion_dictionary(_documents(spark, d))


@query(
    rf"""
WITH tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS word, unnest(generate_series(1, len(t))) AS p FROM tok),
v AS (SELECT word FROM e GROUP BY word HAVING count(*) > 20), k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM e WHERE word IN (SELECT word FROM v) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(k.text, '') AS text FROM documents LEFT JOIN k USING (doc_id)"""
)
def filtered_corpus(spark, d):
    docs = _documents(spark, d)
    return corpus.filtered_corpus(docs, corpus.vocabulary(docs), 20)


_VOCAB = rf"WITH v AS (SELECT unnest({_TOKENS}) AS word FROM documents), vc AS (SELECT word, count(*) AS count FROM v GROUP BY word) "


@query(_VOCAB + "SELECT word, count, CAST(levenshtein(word, 'counsil') AS INTEGER) AS distance FROM vc WHERE abs(length(word) - 7) <= 2 AND levenshtein(word, 'counsil') < 2")
def fuzzy_vocab(spark, d):
    return spelling.fuzzy_matches(corpus.vocabulary(_documents(spark, d)), "counsil")


_WRONG = ["counsil", "brigde", "markt", "council", "zzzzzzzz", "goverment", "hosptial"]


@query(
    _VOCAB
    + f""", q AS (SELECT unnest({_WRONG}) AS query), c AS (SELECT query, word, count, damerau_levenshtein(word, query) AS distance FROM q, vc WHERE abs(length(word) - length(query)) <= 2 AND damerau_levenshtein(word, query) <= 2),
r AS (SELECT query, word, row_number() OVER (PARTITION BY query ORDER BY distance, count DESC, word) AS k FROM c)
SELECT q.query, coalesce(r.word, q.query) AS word FROM q LEFT JOIN r ON q.query = r.query AND r.k = 1"""
)
def spell_norvig(spark, d):
    """The most frequent of the nearest known words."""
    words = spark.createDataFrame([(w,) for w in _WRONG], "query string")
    return spelling.best_words(words, corpus.vocabulary(_documents(spark, d)))


@query()
def spell_compound(spark, d):
    corrector = spelling.Corrector(corpus.vocabulary(_documents(spark, d)).persist())
    texts = ["the counsil opend a brigde", "coun cil market", "nationalmarket"]
    return spark.createDataFrame([(t, corrector.correct(t)) for t in texts], "query string, corrected string")


@query(
    _VOCAB.replace("WITH v", "WITH v", 1)
    + f""", mono AS (SELECT word AS text, CAST(trunc(count / 10) AS BIGINT) AS count FROM vc WHERE length(word) > 3 AND count > 7 AND NOT list_contains({_STOP_LIST}, word))
SELECT text, count FROM mono WHERE starts_with(text, 'co') AND text <> 'co' ORDER BY count DESC, text LIMIT 6"""
)
def suggest_prefix(spark, d):
    return suggest.by_prefix(corpus.monograms(corpus.vocabulary(_documents(spark, d))), "co")


@query()
def suggestions(spark, d):
    suggester = suggest.Suggester.of(corpus.suggestion_dictionary(_documents(spark, d)))
    texts = ["coun", "national hosp", "market brigde", "counsil"]
    return spark.createDataFrame([(t, i, s) for t in texts for i, s in enumerate(suggester.suggest(t), 1)], "query string, rank int, suggestion string")


@query()
def word2vec_expand(spark, d):
    model = expansion.train(_documents(spark, d))
    rows = [(q, *expansion.expanded(model, q)) for q in ("council bridge", "market")]
    return spark.createDataFrame(rows, "query string, expanded string, added array<string>")


# --- enrichment ----------------------------------------------------------------------------------------------------


@query()
def title_sentence_summary(spark, d):
    return enrich.title_summaries(read(spark, d, "articles"), F.col("title"), F.col("content"))


@query()
def pagerank_summary(spark, d):
    return enrich.pagerank_summaries(read(spark, d, "articles"), F.col("title"), F.col("content"), 3)


@query("SELECT doc_id, trim(coalesce(nullif(summary, ''), 'Unable to get summary.')) AS summary FROM doc_records")
def summary_default(spark, d):
    return read(spark, d, "doc_records").select("doc_id", enrich.summary_or_default(F.col("summary")).alias("summary"))


@query()
def sentiment_scores(spark, d):
    return enrich.scored_sentiment(read(spark, d, "articles"), F.col("content"), enrich.word_list_scorer).select("doc_id", enrich.sentiment_entries(F.col("parts")).alias("sentiment"))


@query("""SELECT vec_id, '["negative:' || printf('%.2f', round(vec_id % 7 / 10.0, 2)) || '","neutral:' || printf('%.2f', round(0.1 + vec_id % 3 / 20.0, 2)) || '","positive:' || printf('%.2f', round(1.0 - round(vec_id % 7 / 10.0, 2) - round(0.1 + vec_id % 3 / 20.0, 2), 2)) || '"]' AS sentiment FROM embeddings""")
def sentiment_encoding(spark, d):
    """Rounding and encoding of three parts that are made up from an id."""
    parts = F.array((F.col("vec_id") % 7) / 10.0, F.lit(0.1) + (F.col("vec_id") % 3) / 20.0, F.lit(0.0))
    return read(spark, d, "embeddings").select("vec_id", enrich.sentiment_entries(enrich.rounded_parts(parts)).alias("sentiment"))


@query(
    r"""
WITH a AS (SELECT doc_id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM articles)
SELECT doc_id, trim(regexp_replace(title, '[(\s\p{Z}\x{85}\x{1c}-\x{1f}+)\t"'']+', ' ', 'g')) AS title,
 CASE WHEN len(string_split(content, chr(10))) > 3 THEN trim(regexp_replace(array_to_string(string_split(content, chr(10)), ' '), '[(\s\p{Z}\x{85}\x{1c}-\x{1f}+)\t"'']+', ' ', 'g')) END AS content FROM a
"""
)
def html_extract(spark, d):
    """Titles and texts out of HTML that is made of all articles: escaped characters, nested tags, attributes, scripts and comments."""

    def escaped(text):
        out = text
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ("’", "&rsquo;")):
            out = F.replace(out, F.lit(plain), F.lit(entity))
        return out

    rows = read(spark, d, "articles").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    lines = F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("<p class='a' title=\"x > y\"><span>"), escaped(x), F.lit("</span></p>")))
    head = F.lit("<html><head><title>none</title></head><body><h1 id=h>")
    pages = rows.select("doc_id", F.concat(head, escaped(F.col("title")), F.lit("</h1><script>var x = '</p>';</script><!-- <p>no</p> -->"), F.array_join(lines, "\n"), F.lit("</body></html>")).alias("html"))
    return html.extract_pages(pages).select("doc_id", "title", "content")


@query()
def daily_pipeline(spark, d):
    """Records that the daily job makes of pages whose urls aren't known."""
    articles = read(spark, d, "articles").where("content is not null")
    body = F.concat(F.lit("<h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.regexp_replace("content", "\n", "<p>"))
    pages = articles.where("batch_no > 0").select("url", body.alias("html"), "date", F.col("crawl_date").alias("fetched_at"))
    day = pipeline.run(pages, articles.where("batch_no = 0").select("url"), 1_000_000)
    return day.records


# --- ingest --------------------------------------------------------------------------------------------------------

_LINKS = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY fetched_at DESC NULLS LAST, lastmod DESC NULLS LAST, source ASC NULLS LAST) AS k FROM sitemap_links WHERE loc IS NOT NULL),
links AS (SELECT loc, lastmod, source, fetched_at FROM l WHERE k = 1)
"""


@query(_LINKS + "SELECT loc, lastmod, source FROM links")
def distinct_links(spark, d):
    return ingest.distinct_links(read(spark, d, "sitemap_links")).select("loc", "lastmod", "source")


@query("SELECT loc, lastmod FROM sitemap_links WHERE NOT contains(loc, 'www.harrowpost.example') OR contains(loc, 'https://www.harrowpost.example/news/') OR contains(loc, 'https://www.harrowpost.example/sport/')")
def link_sections(spark, d):
    """Links of one host in chosen sections only."""
    host = "www.harrowpost.example"
    return ingest.in_sections(read(spark, d, "sitemap_links"), host, [f"https://{host}/news/", f"https://{host}/sport/"]).select("loc", "lastmod")


@query(_LINKS + "SELECT loc FROM links WHERE loc NOT IN (SELECT url FROM articles WHERE url IS NOT NULL)")
def new_urls_antijoin(spark, d):
    return ingest.new_links(ingest.distinct_links(read(spark, d, "sitemap_links")), read(spark, d, "articles")).select("loc")


@query(_LINKS + "SELECT loc, (SELECT max(doc_id) FROM articles) + row_number() OVER (ORDER BY fetched_at, loc) AS doc_id FROM links WHERE loc NOT IN (SELECT url FROM articles WHERE url IS NOT NULL)")
def assign_ids(spark, d):
    """New links numbered on from the largest id, in order of arrival."""
    articles = read(spark, d, "articles")
    start = articles.agg(F.max("doc_id")).first()[0] + 1
    fresh = ingest.new_links(ingest.distinct_links(read(spark, d, "sitemap_links")), articles)
    return ingest.assigned_ids(fresh, ["fetched_at", "loc"], start).select("loc", "doc_id")


@query("SELECT loc, lastmod, source, row_number() OVER (ORDER BY loc) - 1 AS doc_id FROM (" + _LINKS.strip() + " SELECT loc, lastmod, source FROM links)")
def reset_ids(spark, d):
    return postings.renumbered(ingest.distinct_links(read(spark, d, "sitemap_links")).select("loc", "lastmod", "source"), ["loc"])


@query(
    _LINKS
    + f", a AS (SELECT loc, coalesce({_day_sql('lastmod')}, DATE '2000-01-01') AS day FROM links) SELECT loc, day, CAST(date_diff('day', day, DATE '2024-06-30') AS INTEGER) AS age_days FROM a WHERE date_diff('day', day, DATE '2024-06-30') <= 365"
)
def recent_links(spark, d):
    """Links of the last year before a day, with their age."""
    return ingest.recent_links(ingest.distinct_links(read(spark, d, "sitemap_links")), F.lit("2024-06-30").cast("date"), 365).select("loc", "day", "age_days")


_PAIR = "''([^'',{}]*|it''s)'': ''([^'']*)''"
_MAP = """CASE WHEN regexp_matches({0}, '^\\{{(PAIR(, )?)*\\}}$') THEN array_to_string(list_sort(list_transform(regexp_extract_all({0}, 'PAIR', 0), lambda x: regexp_replace(x, '^PAIR$', '\\1=\\2'))), '|') END"""


def _map_sql(column: str) -> str:
    """A map's entries as sorted ``key=value`` texts; the apostrophe that occurs stands in "it's"."""
    return f"{_MAP.format(column)} AS {column}".replace("PAIR", _PAIR)


@query(f"SELECT doc_id, {_map_sql('hypertext')}, {_map_sql('figcaption')} FROM articles")
def decoded_maps(spark, d):
    """The links and captions of every article, each map as sorted ``key=value`` texts; null where it is broken."""

    def entries(column: str):
        pairs = F.transform(F.map_entries(ingest.decoded_map(F.col(column))), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return F.array_join(F.sort_array(pairs), "|").alias(column)

    return read(spark, d, "articles").select("doc_id", entries("hypertext"), entries("figcaption"))


@query(
    r"""
SELECT doc_id, url, title, date, array_to_string(list_slice(string_split(content, '.'), 1, 3), '.') AS summary, string_split(url, '.')[2] AS source,
 array_to_string(list_slice(list_slice(string_split(url, '/'), 4, len(string_split(url, '/')) - 1), 1, 2), '-') AS topic FROM articles"""
)
def article_records(spark, d):
    return ingest.records_of(read(spark, d, "articles"))


@query(
    _RECORDS
    + "SELECT rec.doc_id, coalesce(nullif(a.s, ''), rec.summary) AS summary FROM rec LEFT JOIN (SELECT doc_id, max(array_to_string(list_slice(string_split(content, '.'), 1, 3), '.')) AS s FROM articles WHERE doc_id % 2 = 0 GROUP BY doc_id) a USING (doc_id)"
)
def column_upsert(spark, d):
    """Summaries set anew for even ids."""
    fresh = read(spark, d, "articles").where("doc_id % 2 = 0").select("doc_id", F.nullif(text.lead(F.col("content")), F.lit("")).alias("summary"))
    return ingest.upserted(_records(spark, d), fresh, "summary").select("doc_id", "summary")


_FRAGMENTS = """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY source, crawl_date, frag_index ORDER BY loaded_at DESC NULLS LAST, state ASC NULLS LAST, n_articles DESC NULLS LAST) AS k FROM fragments), frag AS (SELECT * FROM f WHERE k = 1)
"""


@query(_FRAGMENTS + "SELECT source, crawl_date, frag_index, n_articles, state FROM frag")
def clean_fragments(spark, d):
    return ingest.clean_fragments(read(spark, d, "fragments")).select("source", "crawl_date", "frag_index", "n_articles", "state")


@query(_FRAGMENTS + "SELECT source, crawl_date, frag_index FROM frag WHERE state = 'pending'")
def pending_fragments(spark, d):
    """The fragments that aren't indexed yet."""
    clean = ingest.clean_fragments(read(spark, d, "fragments"))
    return postings.unprocessed(clean, clean.where("state = 'indexed'")).select("source", "crawl_date", "frag_index")


@query("SELECT source, crawl_date, frag_index, count(*) AS n_articles FROM articles GROUP BY ALL")
def fragment_sizes(spark, d):
    return read(spark, d, "articles").groupBy("source", "crawl_date", "frag_index").agg(F.count(F.lit(1)).alias("n_articles"))


@query("SELECT source, crawl_date, frag_index, state FROM fragments WHERE date_diff('day', crawl_date, CAST(loaded_at AT TIME ZONE 'UTC' AS DATE)) > 3")
def late_loads(spark, d):
    return ingest.late_loads(read(spark, d, "fragments")).select("source", "crawl_date", "frag_index", "state")


@query(
    """
SELECT 'articles' AS artefact, min(doc_id) AS min_id, max(doc_id) AS max_id, count(DISTINCT doc_id) AS n, max(doc_id) - min(doc_id) + 1 = count(DISTINCT doc_id) AS contiguous FROM articles
UNION ALL SELECT 'records', min(doc_id), max(doc_id), count(DISTINCT doc_id), max(doc_id) - min(doc_id) + 1 = count(DISTINCT doc_id) FROM doc_records"""
)
def id_ranges(spark, d):
    return corpus.id_ranges({"articles": read(spark, d, "articles"), "records": read(spark, d, "doc_records")})


@query("SELECT doc_id FROM articles a WHERE EXISTS (SELECT 1 FROM doc_records r WHERE r.doc_id = a.doc_id)")
def known_documents(spark, d):
    return read(spark, d, "articles").join(read(spark, d, "doc_records").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")


@query(
    """
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def windowed_events(spark, d):
    """The stream's window aggregation, over the stored events."""
    from .streaming.ingest import windowed_counts

    return windowed_counts(read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k"""
)
def user_sessions(spark, d):
    from .streaming.ingest import user_sessions as sessions

    return sessions(read(spark, d, "events"))


@query("SELECT min(doc_id) AS doc_id FROM articles WHERE url IS NOT NULL GROUP BY url")
def stream_ingest(spark, d):
    """The articles that a stream over the stored ones takes in: each url once."""
    from .streaming import ingest as stream

    articles = read(spark, d, "articles")
    out = scratch(spark, "stream")
    stream.ingest(stream.read_stream(spark, f"{d}/articles.parquet*", articles.schema), f"{out}/out", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id long").parquet(f"{out}/out/records").select("doc_id").distinct()


@query()
def ranked_in_source(spark, d):
    """Each source's three best documents for a query."""
    docs = _documents(spark, d)
    scored = _tfidf(spark, d, "council bridge").join(docs.select("doc_id", "source"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where("rank <= 3")


SQL["ranked_in_source"] = (
    _tfidf_sql({"council": 1, "bridge": 1})
    + "SELECT doc_id, score, source, CAST(rank AS INTEGER) AS rank FROM (SELECT s.doc_id, s.score, d.source, row_number() OVER (PARTITION BY d.source ORDER BY s.score DESC, s.doc_id) AS rank FROM score s JOIN documents d USING (doc_id)) WHERE rank <= 3"
)


# --- kept sessions and further sources -----------------------------------------------------------------------------


@query(
    _BASE
    + f"""SELECT 'q1' AS query_id, doc_id FROM ({_has('council')} INTERSECT {_has('bridge')}) UNION ALL SELECT 'q2', doc_id FROM (SELECT DISTINCT doc_id FROM documents EXCEPT {_has('council')})
 UNION ALL SELECT 'q3', doc_id FROM ({_phrase_sql('clear', 'council')}) UNION ALL SELECT 'q4', doc_id FROM ({_near_sql(5, 'council', 'bridge')})"""
)
def bool_batch(spark, d):
    """Several boolean queries in one plan."""
    docs = _documents(spark, d)
    asked = [("q1", "council AND bridge"), ("q2", "NOT council"), ("q3", '"clear council"'), ("q4", "#5(council, bridge)"), ("q5", "council NOT bridge")]
    return boolean.search_batch(_index(spark, d, ["bridge", "clear", "council"]), docs, asked)


def _store(spark, d, docs: DataFrame | None = None) -> IndexStore:
    return IndexStore.build(spark, _documents(spark, d) if docs is None else docs, scratch(spark, "store"), stemming=False)


@query(_tfidf_sql({"council": 1, "bridge": 1, "market": 1}) + "SELECT doc_id, score FROM score")
def store_tfidf(spark, d):
    """A ranked query of a session that opens a written index."""
    store = IndexStore.open(spark, _store(spark, d).path)
    return SearchEngine(spark, _documents(spark, d), stemming=False, store=store).tfidf("the council and the bridge market")


@query(_BM25 + _TOP + "<= 10")
def store_bm25(spark, d):
    """BM25 of a session that opens a written index."""
    store = IndexStore.open(spark, _store(spark, d).path)
    return SearchEngine(spark, _documents(spark, d), stemming=False, store=store).bm25("Council bridge")


@query(_BASE + "SELECT term, doc_id, CAST(tf AS INTEGER) AS tf FROM post")
def store_update(spark, d):
    """An index to which a third of the documents is added later."""
    docs = _documents(spark, d)
    store = _store(spark, d, docs.where("doc_id % 3 != 0"))
    return store.updated(None, docs.where("doc_id % 3 = 0"), stemming=False).postings.select("term", "doc_id", "tf")


@query(_BASE + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def store_update_terms(spark, d):
    """The term statistics after an update."""
    docs = _documents(spark, d)
    return _store(spark, d, docs.where("doc_id % 3 != 0")).updated(None, docs.where("doc_id % 3 = 0"), stemming=False).terms


@query(_BM25.replace(r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')", rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+'), lambda x: NOT list_contains({_STOP_LIST}, x))") + _TOP + "<= 10")
def bm25_without_stop_words(spark, d):
    docs = _documents(spark, d)
    rows = postings.letter_postings(docs, ["council", "bridge"], STOP_WORDS)
    return ranked.top(ranked.bm25(rows, postings.doc_lengths(docs, letters_only=True, stop_words=STOP_WORDS), "the Council of the bridge", _size(docs), stop_words=STOP_WORDS), 10)


@query(rf"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(coalesce(title, ''), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains({_STOP_LIST}, lower(x))), ' ') AS title FROM articles")
def cased_titles(spark, d):
    """Titles without stop words, in their letter case."""
    return read(spark, d, "articles").select("doc_id", text.without_stop_words_cased(F.col("title")).alias("title"))


@query(r"SELECT doc_id FROM articles WHERE regexp_matches(title, '[^\s\x0B]') AND regexp_matches(content, '[^\s\x0B]')")
def complete_articles(spark, d):
    return ingest.complete_articles(read(spark, d, "articles")).select("doc_id")


@query(
    _RECORDS.rstrip()
    + """ SELECT coalesce(n.doc_id, rec.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.title ELSE rec.title END AS title, CASE WHEN n.doc_id IS NULL THEN rec.summary END AS summary, CASE WHEN n.doc_id IS NOT NULL THEN n.source ELSE rec.source END AS source
FROM rec FULL JOIN (SELECT doc_id, title, source FROM articles WHERE doc_id % 5 = 0) n ON rec.doc_id = n.doc_id"""
)
def record_upsert(spark, d):
    """Whole records put in for every fifth article."""
    newer = read(spark, d, "articles").where("doc_id % 5 = 0").select("doc_id", "title", "source")
    return ingest.merged_records(_records(spark, d).select("doc_id", "title", "summary", "source"), newer).select("doc_id", "title", "summary", "source")


@query(_CLEAN + "SELECT term, doc_id, array_to_string(positions, ',') AS positions FROM clean WHERE term <> ''")
def index_text_round_trip(spark, d):
    """The index written in its text form and read again."""
    path = scratch(spark, "index-text")
    files.write_index_text(postings.clean_postings(read(spark, d, "index_postings")), path)
    return files.read_index_text(spark, path).select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(_CLEAN + "SELECT term, doc_id, array_to_string(positions, ',') AS positions FROM clean")
def index_json_round_trip(spark, d):
    """The index written as JSON lines, positions as differences, and read again."""
    path = scratch(spark, "index-json")
    files.write_index_json(postings.clean_postings(read(spark, d, "index_postings")), path)
    return files.read_index_json(spark, path).select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, nullif(title, '') AS title, nullif(content, '') AS body FROM articles")
def numbered_csv(spark, d):
    """Articles as CSV, numbered by their rows when they are read."""
    path = scratch(spark, "csv")
    rows = read(spark, d, "articles").select("doc_id", F.nullif("title", F.lit("")).alias("title"), F.nullif("content", F.lit("")).alias("body"))
    files.write_csv(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    return files.read_numbered_csv(spark, path)


@query("SELECT doc_id, source, coalesce(title, '') AS title, coalesce(content, '') AS content, crawl_date, frag_index FROM articles WHERE source IS NOT NULL AND crawl_date IS NOT NULL")
def fragment_files(spark, d):
    """All articles written as fragment files and read again."""
    path = scratch(spark, "fragments")
    rows = read(spark, d, "articles").where("source is not null and crawl_date is not null")
    files.write_named_fragments(rows, path)
    return files.read_fragments(spark, path).select("doc_id", "source", "title", "content", "crawl_date", "frag_index")


@query(
    _LINES.rstrip()
    + r""", w2 AS (SELECT first || ' ' || second AS text, count, unnest(list_distinct([first, second])) AS word FROM big WHERE count > 1)
SELECT word, CAST(k AS INTEGER) AS rank, text, count FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY count DESC, text) AS k FROM w2 WHERE word IN ('council', 'bridge')) WHERE k <= 5"""
)
def word_contexts(spark, d):
    """The word pairs that words stand in most often."""
    pairs = corpus.bigram_counts(_documents(spark, d)).where("count > 1").select(F.concat_ws(" ", "first", "second").alias("text"), "count")
    return suggest.word_contexts(pairs, spark.createDataFrame([("council",), ("bridge",), ("zzz",)], "word string"))


@query(
    _VOCAB.rstrip()
    + """, s AS (SELECT * FROM (VALUES ('council', 'assembly hall'), ('bridge', 'council'), ('zzz', 'none')) AS t(word, synonym)), m AS (SELECT word AS text, count FROM vc WHERE count > 50)
SELECT text, count FROM m UNION ALL SELECT s.synonym, max(m.count) FROM s JOIN m ON s.word = m.text WHERE s.synonym NOT IN (SELECT text FROM m) GROUP BY 1"""
)
def synonym_dictionary(spark, d):
    """A dictionary with the synonyms of its words."""
    words = corpus.vocabulary(_documents(spark, d)).where("count > 50").select(F.col("word").alias("text"), "count")
    return suggest.with_synonyms(words, spark.createDataFrame([("council", "assembly hall"), ("bridge", "council"), ("zzz", "none")], "word string, synonym string"))


@query(_PARTS + "SELECT doc_id, CASE WHEN positive > neutral AND positive > negative THEN 'positive' WHEN neutral > negative THEN 'neutral' ELSE 'negative' END AS label FROM x")
def sentiment_labels(spark, d):
    """The label of the largest part of each record's sentiment, of equal ones the more negative."""
    return _records(spark, d).select("doc_id", results.sentiment_label(results.sentiment_parts(F.col("sentiment"))).alias("label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
