"""Problem 6: how distinctive each term is of a record.

Method: the log-likelihood ratio of the two-by-two table (term or other term, record or rest of the
collection), positive where the term is more frequent in the record than elsewhere.

Terms are maximal runs of letters, digits and underscores in lower case. A null title or content counts
as empty; a record without terms has no rows; ties go to the term that is first in code point order.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, chosen, materialise
from .frequencies import WORD, word_partials

#: Share of the collection's occurrences from which a term is joined by broadcast; at most 1 / share terms reach it.
HOT_SHARE = 1e-4
#: The same for terms that are scored where their record is read.
KNOWN_SHARE = 1e-5


def record_text(articles: DataFrame) -> DataFrame:
    """(doc_id, text): title, line break, content."""
    return chosen(articles, ("doc_id", "title", "content")).select("doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))).alias("text"))


def record_terms(texts: DataFrame) -> DataFrame:
    """(doc_id, term, tf, length): the terms of each record with the record's number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, counts, lengths = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(WORD.findall(text.lower()) if text else ())
                ids += [doc] * len(found)
                terms += found.keys()
                counts += found.values()
                lengths += [found.total()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], names=["doc_id", "term", "tf", "length"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, term string, tf long, length long")


def log_likelihood_ratio(tf: Column, length: Column, cf: Column, total: Column) -> Column:
    """Twice the log-likelihood ratio, negative for terms that are rarer in the record than in the rest."""

    def x_log(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))

    rest, other = cf - tf, length - tf
    outside = total - length
    fourth = outside - rest
    ratio = 2 * (
        x_log(tf, length * cf / total)
        + x_log(other, length * (total - cf) / total)
        + x_log(rest, outside * cf / total)
        + x_log(fourth, outside * (total - cf) / total)
    )
    return F.when(tf * outside >= rest * length, ratio).otherwise(-ratio)


def scored_terms(texts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, cf, score) of every term of the records in ``of`` (all, if None) against all records of ``texts``.

    The few terms that hold much of the collection are joined by broadcast, so that none is a hot key.
    """
    counts = materialise(word_partials(texts).groupBy("term").agg(F.sum("n_occurrences").alias("cf")), "term-counts")
    total = F.lit(counts.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0])
    mine = texts if of is None else texts.join(bounded_broadcast(of.where("doc_id is not null").select("doc_id").distinct()), "doc_id", "left_semi")
    terms = record_terms(mine)
    hot = counts.where(F.col("cf") > total * HOT_SHARE)
    split = terms.join(F.broadcast(hot.withColumnRenamed("cf", "hot_cf")), "term", "left")
    # a term found among the hot ones gets a key that matches nothing, spread by record
    key = F.when(F.col("hot_cf").isNull(), F.col("term")).otherwise(F.concat(F.lit("\0"), F.col("doc_id").cast("string")))
    both = split.withColumn("key", key).join(counts.select(F.col("term").alias("key"), F.col("cf").alias("rest_cf")), "key", "left").withColumn("cf", F.coalesce("hot_cf", "rest_cf"))
    return both.select("doc_id", "term", "tf", "cf", log_likelihood_ratio(F.col("tf"), F.col("length"), F.col("cf"), total).alias("score"))


def _ratio(tf: int, length: int, cf: int, total: int) -> float:
    """``log_likelihood_ratio`` of numbers."""
    outside, rest = total - length, cf - tf
    cells = ((tf, length * cf), (length - tf, length * (total - cf)), (rest, outside * cf), (outside - rest, outside * (total - cf)))
    ratio = 2 * sum(observed * math.log(observed * total / expected) for observed, expected in cells if observed > 0)
    return ratio if tf * outside >= rest * length else -ratio


def best_terms(texts: DataFrame, k: int = 1) -> DataFrame:
    """(doc_id, rank, term, tf, cf, score): the ``k`` most distinctive terms of every record.

    The terms that hold at least ``KNOWN_SHARE`` of the collection, 1 / share at most, are held by every worker and scored
    where the record is read, so that only the best of them leave it; the rare rest is joined with its counts.
    """
    spark = texts.sparkSession
    counts = materialise(word_partials(texts).groupBy("term").agg(F.sum("n_occurrences").alias("cf")), "term-counts")
    total = counts.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
    known = spark.sparkContext.broadcast(dict(counts.where(F.col("cf") > total * KNOWN_SHARE).collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = known.value
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(WORD.findall(text.lower()) if text else ())
                length = found.total()
                best = heapq.nsmallest(k, ((-round(_ratio(tf, length, counted[t], total), 9), t, tf) for t, tf in found.items() if t in counted))
                rows += [(doc, t, tf, length, counted[t], -score) for score, t, tf in best]
                rows += [(doc, t, tf, length, None, None) for t, tf in found.items() if t not in counted]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "term", "tf", "length", "cf", "score"])

    found = materialise(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, term string, tf long, length long, cf long, score double"), "record-terms")
    rest = found.where("cf is null").drop("cf", "score").join(counts, "term")
    rest = rest.select("doc_id", "term", "tf", "cf", F.round(log_likelihood_ratio(F.col("tf"), F.col("length"), F.col("cf"), F.lit(total)), 9).alias("score"))
    return top_terms(found.where("cf is not null").select("doc_id", "term", "tf", "cf", "score").unionByName(rest), k)


def top_terms(scored: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` highest scores of each record, ranked from 1."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
