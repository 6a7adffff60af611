"""Boolean retrieval: one grouping of the query's postings by document, whatever the query.

The postings of the query's terms are grouped by document into one array of positions per term; every operand is then
a column over these arrays, and the query is one boolean column. Only a query with NOT also needs the document ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import delta_encoded
from ..functions.text import STOP_WORDS
from ..plans import query as language


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= distance))


def _phrase(arrays: list[Column], mode: str) -> Column:
    later = [delta_encoded(a) for a in arrays[1:]] if mode == "raw_delta" else arrays[1:]
    if not later:
        return arrays[0].isNotNull()
    return F.exists(arrays[0], lambda p: reduce(lambda x, y: x & y, [F.array_contains(a, p + i) for i, a in enumerate(later, 1)]))


def condition(tree: language.Leaf | language.Node, place: dict[str, Column], phrase_mode: str = "positions") -> Column:
    """The query as a column over the positions of its terms; a missing term makes an operand false."""

    def leaf(operand: language.Leaf) -> Column:
        arrays = [place[w] for w in operand.words]
        if not arrays:
            return F.lit(False)
        if operand.kind == "word":
            found = arrays[0].isNotNull()
        elif operand.kind == "phrase":
            found = _phrase(arrays, phrase_mode)
        else:
            found = _near(arrays[0], arrays[1], operand.distance)
        return F.coalesce(found, F.lit(False))

    return language.folded(tree, leaf, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)


def search(postings: DataFrame, docs: DataFrame, query: str, stopping: bool = True, stemming: bool = False, phrase_mode: str = "positions", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(doc_id): the documents that satisfy the query, each once; none for a query that isn't valid.

    ``postings`` has term, doc_id and positions; ``docs`` is needed for its ids, where NOT occurs.
    """
    tree = language.parse(query, stopping, stemming, stop_words)
    if tree is None:
        return docs.select("doc_id").limit(0)
    terms = language.terms(tree)
    names = {t: f"p{i}" for i, t in enumerate(terms)}
    rows = postings.where(F.col("term").isin(*terms)) if terms else postings.limit(0)
    found = rows.groupBy("doc_id").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(n) for t, n in names.items()] or [F.count(F.lit(1)).alias("n")])
    if language.has_not(tree):
        found = docs.select("doc_id").distinct().join(found, "doc_id", "left")
    return found.where(condition(tree, {t: F.col(n) for t, n in names.items()}, phrase_mode)).select("doc_id")


def search_batch(postings: DataFrame, docs: DataFrame, queries: list[tuple[str, str]], stopping: bool = True, stemming: bool = False, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(query_id, doc_id) of several queries in one plan: the postings of all their terms are grouped by document once.

    Queries that aren't valid find nothing; a query id that stands twice is asked twice and found once.
    """
    trees = [(i, language.parse(text, stopping, stemming, stop_words)) for i, text in queries]
    trees = [(i, tree) for i, tree in trees if tree is not None]
    terms = list(dict.fromkeys(t for _, tree in trees for t in language.terms(tree)))
    if not trees:
        return docs.select(F.lit("").alias("query_id"), "doc_id").limit(0)
    names = {t: f"p{i}" for i, t in enumerate(terms)}
    rows = postings.where(F.col("term").isin(*terms)) if terms else postings.limit(0)
    found = rows.groupBy("doc_id").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(n) for t, n in names.items()] or [F.count(F.lit(1)).alias("n")])
    if any(language.has_not(tree) for _, tree in trees):
        found = docs.select("doc_id").distinct().join(found, "doc_id", "left")
    place = {t: F.col(n) for t, n in names.items()}
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(condition(tree, place), F.lit(i)) for i, tree in trees])))
    return found.select(F.explode(hits).alias("query_id"), "doc_id")


def set_operation(name: str, left: DataFrame, right: DataFrame | None = None, universe: DataFrame | None = None) -> DataFrame:
    """AND, OR and NOT over sets of doc_ids that are DataFrames of their own."""
    if name == "AND":
        return left.select("doc_id").distinct().join(right.select("doc_id"), "doc_id", "left_semi")
    if name == "OR":
        return left.select("doc_id").union(right.select("doc_id")).distinct()
    if name == "NOT":
        return universe.select("doc_id").distinct().join(left.select("doc_id"), "doc_id", "left_anti")
    raise ValueError(name)
