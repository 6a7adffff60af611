"""Problem 3: occurrences and record presence of every distinct term.

Method: a global dictionary gives every term a dense integer; the terms are encoded, counts are
accumulated in arrays over blocks of identifiers, and the arrays are summed by identifier range.

Null terms count nowhere. A (record, term) that is spread over rows or repeated counts as one presence,
and its occurrences are its distinct positions. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, chosen, materialise

#: Identifiers of a block; two arrays of this many 64-bit counts are what a task holds at a time.
BLOCK = 1 << 16
#: Shares into which the rows of one term are split before they are joined.
SALTS = 16
#: Distinct terms after which a worker hands on its partial counts.
_FLUSH = 400_000

WORD = re.compile(r"\w+")


def posting_pairs(postings: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, term, occurrences): one row per record and normalised term, of records in ``records`` only.

    The pairs are grouped by record and term, so a term in every record is no hot key.
    """
    ids = materialise(records.where("doc_id is not null").select("doc_id").distinct(), "record-ids")
    rows = chosen(postings, ("term", "doc_id", "positions")).where("term is not null")
    rows = rows.join(bounded_broadcast(ids), "doc_id", "left_semi")
    positions = F.flatten(F.collect_set(F.coalesce("positions", F.array().cast("array<int>"))))
    return rows.groupBy("doc_id", F.lower(F.trim("term")).alias("term")).agg(F.size(F.array_distinct(positions)).cast("long").alias("occurrences"))


def pair_partials(pairs: DataFrame) -> DataFrame:
    """(term, n_records, n_occurrences): partial sums, at most ``SALTS`` rows a term."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    return pairs.groupBy("term", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("occurrences").alias("n_occurrences")).drop("salt")


def word_partials(texts: DataFrame) -> DataFrame:
    """(term, n_records, n_occurrences) of the words of column ``text``, combined within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        present: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            terms = list(total)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([present[t] for t in terms], pa.int64()), pa.array([total[t] for t in terms], pa.int64())], names=["term", "n_records", "n_occurrences"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words = WORD.findall(text.lower())
                    total.update(words)
                    present.update(set(words))
            if len(total) > _FLUSH:
                yield out()
                total.clear()
                present.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "term string, n_records long, n_occurrences long")


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, id): dense identifiers from 0 in the order of the terms; ``terms`` has distinct terms.

    Only the number of terms of each partition reaches the driver.
    """
    ordered = terms.select("term").repartitionByRange("term").sortWithinPartitions("term")
    placed = materialise(ordered.select("term", F.monotonically_increasing_id().alias("at")), "terms")
    shift = 1 << 33
    starts, start = [], 0
    for part, n in sorted(placed.groupBy(F.expr(f"at div {shift}").alias("part")).count().collect()):
        starts.append((part, start))
        start += n
    offsets = terms.sparkSession.createDataFrame(starts or [(0, 0)], "part long, start long")
    at = F.col("at")
    return placed.withColumn("part", F.expr(f"at div {shift}")).join(F.broadcast(offsets), "part").select("term", (F.col("start") + at % shift).alias("id"))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, records, occurrences = (batch.column(i).to_numpy() for i in (1, 2, 3))
        blocks = ids // BLOCK
        for block in np.unique(blocks):
            mine = blocks == block
            sums = held.setdefault(int(block), np.zeros((2, BLOCK), np.int64))
            np.add.at(sums[0], ids[mine] % BLOCK, records[mine])
            np.add.at(sums[1], ids[mine] % BLOCK, occurrences[mine])
    for block, sums in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([row], pa.list_(pa.int64())) for row in sums)], names=["block", "records", "occurrences"])


def frequencies(partials: DataFrame) -> DataFrame:
    """(term, n_records, n_occurrences): the exact counts of every term; ``partials`` is materialised.

    A block of identifiers is summed by one task; blocks are equal in size, so no term or block is hot.
    """
    terms = materialise(dictionary(partials.select("term").distinct()), "dictionary")
    encoded = partials.join(bounded_broadcast(terms), "term").select(F.expr(f"id div {BLOCK}").alias("block"), "id", "n_records", "n_occurrences")
    arrays = encoded.repartition("block").mapInArrow(_arrays, "block long, records array<long>, occurrences array<long>")
    counts = arrays.select("block", F.posexplode(F.arrays_zip("records", "occurrences")).alias("at", "n")).where("n.records > 0")
    by_id = counts.select((F.col("block") * BLOCK + F.col("at")).alias("id"), F.col("n.records").alias("n_records"), F.col("n.occurrences").alias("n_occurrences"))
    return by_id.join(terms, "id").select("term", "n_records", "n_occurrences")


def mark(n_records: Column, n: Column, rare: int = 2, common_share: float = 0.3) -> Column:
    """``rare`` up to ``rare`` records, ``common`` above that from ``common_share`` of all records on, else null."""
    return F.when(n_records <= rare, "rare").when(n_records >= n * common_share - F.lit(1e-9), "common")
