"""Ranked retrieval: TF-IDF, BM25 and dense vectors; single queries and batches of queries in one plan."""

from __future__ import annotations

from collections import Counter
from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stem import stem
from ..functions.text import STOP_WORDS
from ..functions.vectors import cosine
from ..plans import query as language


def query_terms(query: str, stopping: bool = True, stemming: bool = False, stop_words: frozenset[str] = STOP_WORDS) -> Counter[str]:
    """The terms of a query text with their multiplicity."""
    words = [w.lower() for w in language._WORD.findall(query) if any(c.isascii() and c.isalnum() for c in w)]
    words = [w for w in words if not (stopping and w in stop_words)]
    return Counter(stem(w) if stemming else w for w in words)


def query_table(postings: DataFrame, queries: list[tuple[str, str]], stopping: bool = True, stemming: bool = False, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(query_id, term, qtf) of query texts: as small as the texts that were typed."""
    rows = [(i, t, n) for i, text in queries for t, n in query_terms(text, stopping, stemming, stop_words).items()]
    return postings.sparkSession.createDataFrame(rows, "query_id string, term string, qtf int")


def _matched(postings: DataFrame, table: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the terms, with df; the filter on term reaches the scan."""
    rows = postings.where(F.col("term").isin(*terms)) if terms else postings.limit(0)
    stats = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return rows.select("term", "doc_id", "tf").join(F.broadcast(table.join(stats, "term")), "term")


def tfidf_batch(postings: DataFrame, queries: list[tuple[str, str]], n_docs: int, stopping: bool = True, stemming: bool = False, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(query_id, doc_id, score): sum over the query's tokens of (1 + log10 tf) * log10(N / df), of documents with any term.

    A repeated query word counts as often as it is said; an unknown word counts nothing; a score of 0 stays.
    """
    table = query_table(postings, queries, stopping, stemming, stop_words)
    terms = sorted({t for _, text in queries for t in query_terms(text, stopping, stemming, stop_words)})
    weight = F.col("qtf") * (1 + F.log10("tf")) * F.log10(F.lit(float(n_docs)) / F.col("df"))
    return _matched(postings, table, terms).groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def tfidf(postings: DataFrame, query: str, n_docs: int, stopping: bool = True, stemming: bool = False, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(doc_id, score) of one query."""
    return tfidf_batch(postings, [("q", query)], n_docs, stopping, stemming, stop_words).select("doc_id", "score")


#: Postings up to which a lookup runs in one task, where nothing is shuffled; what a task sums in well under a second.
ONE_TASK_POSTINGS = 2_000_000


def tfidf_known(postings: DataFrame, terms: Counter[str], df: dict[str, int], n_docs: int) -> DataFrame:
    """``tfidf`` of terms whose document frequencies are known: one scan of a written index, without a join.

    The frequencies also tell how many postings are read: few are summed by one task, many are shuffled by document.
    """
    known = {t: n for t, n in terms.items() if df.get(t)}
    rows = postings.where(F.col("term").isin(*known)) if known else postings.limit(0)
    if sum(df[t] for t in known) <= ONE_TASK_POSTINGS:
        rows = rows.coalesce(1)
    weight = F.lit(None).cast("double")
    for term, n in known.items():
        weight = F.when(F.col("term") == term, F.lit(n * log10(n_docs / df[term]))).otherwise(weight)
    return rows.select("doc_id", (weight * (1 + F.log10("tf"))).alias("part")).groupBy("doc_id").agg(F.sum("part").alias("score"))


def bm25(
    postings: DataFrame, lengths: DataFrame, query: str, n_docs: int, k1: float = 1.2, b: float = 0.75, included: DataFrame | None = None, stop_words: frozenset[str] = frozenset()
) -> DataFrame:
    """(doc_id, score) with idf log10(N / df); a query term counts once. ``included`` restricts the documents, not df.

    With ``stop_words`` these are left out of the query; take them out of ``postings`` and ``lengths`` as well.
    """
    terms = sorted(dict.fromkeys(w.lower() for w in _letters(query) if w.lower() not in stop_words))
    rows = postings.where(F.col("term").isin(*terms)) if terms else postings.limit(0)
    stats = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    average = lengths.agg(F.avg("dl")).first()[0] or 1.0
    if included is not None:
        rows = rows.join(included.select("doc_id").distinct(), "doc_id", "left_semi")
    tf = F.col("tf")
    part = F.log10(F.lit(float(n_docs)) / F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(average)))
    return rows.select("term", "doc_id", "tf").join(F.broadcast(stats), "term").join(lengths, "doc_id").groupBy("doc_id").agg(F.sum(part).alias("score"))


def _letters(query: str) -> list[str]:
    out, word = [], ""
    for c in query + " ":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def top(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id", places: int = 6) -> DataFrame:
    """The ``k`` best rows, ranked from 1; scores are rounded before they are compared, ties go to the smaller key."""
    rounded = scored.withColumn(score, F.round(score, places))
    best = rounded.orderBy(F.desc(score), F.asc(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))


def top_per_query(scored: DataFrame, k: int, places: int = 6) -> DataFrame:
    """The ``k`` best documents of each query of a batch."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("score", F.round("score", places)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_top(vectors: DataFrame, query: list[float] | Column, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, sim, rank): the ``k`` vectors nearest by cosine; the query vector is a literal, so nothing is shuffled but the best."""
    literal = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col(column).isNotNull()).select(key, cosine(F.col(column), literal).alias("sim"))
    return top(scored, k, "sim", key)


def phrase_joined(postings: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id) of a phrase by joining position rows: the relational form of the phrase operand."""
    rows = postings.where(F.col("term").isin(*words)).select("doc_id", "term", F.explode("positions").alias("p"))
    places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)])
    starts = rows.withColumn("x", F.explode(F.filter(places, lambda s: s["w"] == F.col("term")))).select("doc_id", (F.col("p") - F.col("x.i")).alias("start"), "x.i")
    return starts.groupBy("doc_id", "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(words)).select("doc_id").distinct()
