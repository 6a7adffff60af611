"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cut, distinctive, frequencies, history, mixing, packing, quality, tokens
from .common import bounded_broadcast, materialise, read, removed
from .lines import line_keys, occurrences, repeated_lines, without_repeated_lines
from .residue import residue_flags


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keys = materialise(line_keys(read(spark, d, "articles")), "line-keys")
    return keys, materialise(repeated_lines(keys), "repeated-lines")


def _residue(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return residue_flags(read(spark, d, "articles"), read(spark, d, "news_sites"), _lines(spark, d)[1], keep=keep)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).where("kind != ''").select("doc_id").distinct()


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many articles each kind of residue takes out."""
    return _residue(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n_articles"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return occurrences(*_lines(spark, d)).distinct()


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every article's content without its source's repeated lines."""
    return without_repeated_lines(read(spark, d, "articles"), _lines(spark, d)[1])


def _marked(partials: DataFrame, n: int) -> DataFrame:
    counted = frequencies.frequencies(materialise(partials, "partials"))
    return counted.withColumn("mark", frequencies.mark(F.col("n_records"), F.lit(n)))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    pairs = materialise(frequencies.posting_pairs(read(spark, d, "index_postings"), read(spark, d, "articles")), "pairs")
    n = pairs.agg(F.count_distinct("doc_id")).first()[0]
    return _marked(frequencies.pair_partials(pairs), n)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and articles of every term of index_postings, with its mark."""
    return _postings(spark, d)


def p3_words(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and articles of every word of articles.content, with its mark."""
    articles = read(spark, d, "articles")
    n = articles.where("content is not null").count()
    return _marked(frequencies.word_partials(articles.select(F.col("content").alias("text"))).groupBy("term").agg(F.sum("n_records").alias("n_records"), F.sum("n_occurrences").alias("n_occurrences")), n)


def _news(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, own, ...): the articles that are no p1 cases, with their content less its source's repeated lines."""
    flagged = residue_flags(read(spark, d, "articles"), read(spark, d, "news_sites"), _lines(spark, d)[1], keep=keep, own=True)
    return flagged.where("kind = ''").drop("kind", "coverage")


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    """``history.prepared`` of ``_news``, made where the texts are judged."""

    def columns():
        coder = history.WordCodes()
        return lambda texts, urls, _: history.prepared_columns(coder, urls.to_pylist(), texts)

    keys, repeated = _lines(spark, d)
    removed(keys)
    flagged = residue_flags(read(spark, d, "articles"), read(spark, d, "news_sites"), repeated, keep=("url", "batch_no"), derived=(history.PREPARED, columns))
    batch = F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch_no")
    return flagged.where("kind = '' and doc_id is not null").select("doc_id", batch, "page", "text_key", "codes")


def _repeats(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_articles(spark, _prepared(spark, d), read(spark, d, "articles").count())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _repeats(spark, d)


def p4_accepted(spark: SparkSession, d: str) -> DataFrame:
    """The articles that are kept: the history and the new ones that repeat nothing."""
    repeats = materialise(_repeats(spark, d), "repeats").select(F.col("doc_id_b").alias("doc_id"))
    return _residue(spark, d, keep=("batch_no",)).where("kind = ''").select("doc_id", "batch_no").join(bounded_broadcast(repeats), "doc_id", "left_anti")


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    own = _news(spark, d).select("doc_id", F.col("own").alias("text"))
    return cut.cut_texts(materialise(own, "own-texts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("cut").select("doc_id").distinct()


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut articles of each source."""
    return cut.cut_report(_cuts(spark, d), read(spark, d, "articles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts = distinctive.record_text(read(spark, d, "articles"))
    return distinctive.top_terms(distinctive.scored_terms(texts, read(spark, d, "term_probes"))).select("doc_id", "term")


def p6_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The five most distinctive terms of every article."""
    best = distinctive.best_terms(distinctive.record_text(read(spark, d, "articles")), 5)
    return best.select("doc_id", "rank", "term", "tf", "cf", F.round("score", 4).alias("score"))


def _sizes(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return materialise(tokens.token_counts(read(spark, d, "documents"), keep), "sizes")


def _capacity(spark: SparkSession, d: str, profile: str) -> int:
    return read(spark, d, "packing").where(F.col("profile") == profile).agg(F.max("capacity_tokens")).first()[0]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_texts(packing.packed(_sizes(spark, d), _capacity(spark, d, "base")))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """The window of every document's pieces at profile ``base``."""
    return packing.packed(_sizes(spark, d), _capacity(spark, d, "base"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the windows of each profile are."""
    sizes = _sizes(spark, d)
    out = None
    for profile, capacity in read(spark, d, "packing").where("profile is not null and capacity_tokens > 0").distinct().collect():
        one = packing.fill_report(packing.packed(sizes, capacity), capacity).withColumn("profile", F.lit(profile))
        out = one if out is None else out.unionByName(one)
    return out


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    documents = read(spark, d, "documents").withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))))
    sizes = materialise(tokens.token_counts(documents, ("source", "text_key")), "mix-sizes")
    targets = mixing.clean_targets(read(spark, d, "mix_targets"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    texts = materialise(mixing.texts_by_pattern(sizes, targets), "mix-texts")
    return texts, targets, mixing.plan_frame(texts, targets, total), total


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(_mix(spark, d)[2])


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used for each source of the mix."""
    texts, _, planned, _ = _mix(spark, d)
    return mixing.selection(texts, planned)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the mix that each source reaches."""
    texts, targets, planned, total = _mix(spark, d)
    return mixing.reached_shares(mixing.selection(texts, planned), targets, total)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(read(spark, d, "documents")).where("kind in ('list', 'table', 'junk')").select("doc_id").distinct()


def p9_figures(spark: SparkSession, d: str) -> DataFrame:
    """The figures and the kind of every document."""
    return quality.quality(read(spark, d, "documents"))


def p9_labels(spark: SparkSession, d: str) -> DataFrame:
    """How the kinds agree with the labelled sample."""
    return quality.agreement(p9_figures(spark, d), read(spark, d, "quality_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_kinds": p1_kinds,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p3_words": p3_words,
    "p4_found": p4_found,
    "p4_accepted": p4_accepted,
    "p5_found": p5_found,
    "p5_sources": p5_sources,
    "p6_found": p6_found,
    "p6_top_terms": p6_top_terms,
    "p7_found": p7_found,
    "p7_windows": p7_windows,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_figures": p9_figures,
    "p9_labels": p9_labels,
}

#: DuckDB statements for the queries that SQL can express over whole tables.
_POSTING_COUNTS = """
WITH ids AS (SELECT DISTINCT doc_id FROM articles),
valid AS (SELECT lower(trim(p.term, ' ')) AS term, p.doc_id, p.positions FROM index_postings p JOIN ids USING (doc_id) WHERE p.term IS NOT NULL),
total AS (SELECT count(DISTINCT doc_id) AS n FROM valid),
pairs AS (SELECT term, doc_id, len(list_distinct(flatten(list(positions)))) AS occurrences FROM valid GROUP BY term, doc_id),
counts AS (SELECT term, count(*) AS n_records, CAST(sum(occurrences) AS BIGINT) AS n_occurrences FROM pairs GROUP BY term),
marked AS (SELECT term, n_records, n_occurrences, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records >= 0.3 * (SELECT n FROM total) THEN 'common' END AS mark FROM counts)
"""

_REPEATED = r"""
WITH split AS (SELECT doc_id, coalesce(source, '') AS source, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM articles WHERE content IS NOT NULL AND content <> ''),
normal AS (SELECT doc_id, source, line_no, line, regexp_replace(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '', 'g'), '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g'), '^[^\p{L}]+|[^\p{L}]+$', '', 'g') AS key FROM split),
totals AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM articles GROUP BY 1),
heavy AS (SELECT source, key FROM normal WHERE key <> '' GROUP BY source, key HAVING count(DISTINCT doc_id) >= 5)
, confirmed AS (SELECT h.source, h.key FROM heavy h JOIN totals t USING (source) JOIN (SELECT source, key, count(DISTINCT doc_id) AS d FROM normal GROUP BY 1, 2) c USING (source, key) WHERE c.d >= 0.02 * t.n)
"""

_SCORES = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(content, '')), '[\p{L}\p{N}_]+')) AS term FROM articles),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM words WHERE doc_id IN (SELECT doc_id FROM term_probes) GROUP BY doc_id, term),
len AS (SELECT doc_id, sum(tf) AS l FROM tf GROUP BY doc_id), cf AS (SELECT term, count(*)::DOUBLE AS cf FROM words GROUP BY term), total AS (SELECT count(*)::DOUBLE AS n FROM words),
cells AS (SELECT doc_id, term, tf, l, cf, n, unnest([tf, l - tf, cf - tf, n - l - cf + tf]) AS o, unnest([l * cf / n, l * (n - cf) / n, (n - l) * cf / n, (n - l) * (n - cf) / n]) AS e FROM tf JOIN len USING (doc_id) JOIN cf USING (term), total),
score AS (SELECT doc_id, term, tf, cf, CASE WHEN tf * (n - l) >= (cf - tf) * l THEN 1 ELSE -1 END * 2 * sum(CASE WHEN o > 0 THEN o * ln(o / e) ELSE 0 END) AS score FROM cells GROUP BY doc_id, term, tf, l, cf, n)
"""

SQL: dict[str, str] = {
    "p3_found": _POSTING_COUNTS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": _POSTING_COUNTS + "SELECT term, n_records, n_occurrences, mark FROM marked",
    "p3_words": r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) AS term FROM articles),
counts AS (SELECT term, count(DISTINCT doc_id) AS n_records, count(*) AS n_occurrences FROM words GROUP BY term),
total AS (SELECT count(*) AS n FROM articles WHERE content IS NOT NULL)
SELECT term, n_records, n_occurrences, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records >= 0.3 * (SELECT n FROM total) THEN 'common' END AS mark FROM counts
""",
    "p2_found": _REPEATED + "SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no FROM normal JOIN confirmed USING (source, key)",
    "p2_clean": _REPEATED
    + """, kept AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY line_no) AS content, count(*) AS k FROM normal n LEFT JOIN confirmed c USING (source, key) WHERE c.key IS NULL GROUP BY n.doc_id)
SELECT a.doc_id, CASE WHEN a.content IS NOT NULL THEN coalesce(kept.content, '') END AS content,
 CAST(CASE WHEN coalesce(a.content, '') = '' THEN 0 ELSE len(string_split(a.content, chr(10))) - coalesce(k, 0) END AS INTEGER) AS n_removed FROM articles a LEFT JOIN kept USING (doc_id)
""",
    "p6_found": _SCORES + "SELECT doc_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS k FROM score) WHERE k = 1",
    "p6_top_terms": _SCORES.replace("WHERE doc_id IN (SELECT doc_id FROM term_probes) ", "")
    + "SELECT doc_id, CAST(k AS INTEGER) AS rank, term, CAST(tf AS BIGINT) AS tf, CAST(cf AS BIGINT) AS cf, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS k FROM score) WHERE k <= 5",

}
