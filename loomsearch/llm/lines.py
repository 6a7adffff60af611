"""Problem 2: lines repeated across the documents of one source.

Method: every partition builds a mergeable heavy-hitter summary (Misra-Gries) of each
source's line keys; the summaries are added, candidates are counted exactly in a second
pass, and the confirmed lines are removed through broadcast sets.

Null or empty texts have no lines; a null source is a source of its own (written ``''``);
an empty table gives empty results; repeated rows of one ``doc_id`` count once in the
article count of a line.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, chosen, materialise, parts_of

MIN_ARTICLES = 5
MIN_SHARE = 0.02
#: Counters that a partition's summary keeps for each source.
SUMMARY_SIZE = 4096
#: Distinct raw lines whose keys a worker remembers.
_CACHE_LINES = 50_000

_DIGITS = re.compile(r"\d+")


def normal_line(line: str) -> str:
    """The form in which two lines are compared; ``''`` if nothing is left.

    Lower case, no digits, each run of any white space one space, nothing but letters at the ends.
    """
    text = " ".join(_DIGITS.sub("", line.lower()).split())
    start, end = 0, len(text)
    while start < end and not text[start].isalpha():
        start += 1
    while end > start and not text[end - 1].isalpha():
        end -= 1
    return text[start:end]


#: The last bits of a key are the length of the normalised line, up to this.
_LENGTH_BITS = 12
_LONGEST = (1 << _LENGTH_BITS) - 1
_LETTERS = bytes(i for i in range(128) if chr(i).isalpha())


class LineKeys:
    """63-bit keys of normalised lines, 51 bits of a hash and 12 of the length; 0 stands for a line with nothing left."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self._longest: dict[str, int] = {}

    def __call__(self, line: str) -> int:
        key = self.known.get(line)
        if key is None:
            text = normal_line(line)
            key = (xxhash.xxh3_64_intdigest(text) >> 1 + _LENGTH_BITS << _LENGTH_BITS) | min(len(text), _LONGEST) if text else 0
            if len(self.known) >= _CACHE_LINES:
                self.known.clear()
            self.known[line] = key
        return key

    def longest(self, source: str, known: frozenset[int]) -> int:
        """The length of the longest of a source's repeated lines; that of lines beyond the length that keys tell is not bounded."""
        length = self._longest.get(source)
        if length is None:
            length = max(key & _LONGEST for key in known)
            length = self._longest[source] = length if length < _LONGEST else 1 << 62
        return length

    def of(self, content: str | None) -> list[int]:
        return [self(line) for line in content.split("\n")] if content else []


def line_keys(articles: DataFrame) -> DataFrame:
    """(doc_id, source, keys): of each row the key of each of its lines, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = LineKeys()
        for batch in batches:
            lists = [keys.of(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "source", "keys"])

    source = F.coalesce("source", F.lit("")).alias("source")
    return chosen(articles, ("doc_id", "source", "content")).select("doc_id", source, "content").mapInArrow(run, "doc_id long, source string, keys array<long>")


def _shrink(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The Misra-Gries step: the largest counters, each less the first one dropped."""
    if len(keys) <= size:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1])
    keep = counts > cut
    return keys[keep], counts[keep] - cut, cut


def _summaries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # source: keys, counts, error, rows
        for batch in batches:
            sources = batch.column(1).to_pylist()
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            rows_of: dict[str, list[int]] = {}
            for row, source in enumerate(sources):
                rows_of.setdefault(source, []).append(row)
            for source, rows in rows_of.items():
                once = [np.unique(values[offsets[r] : offsets[r + 1]]) for r in rows]
                entry = held.setdefault(source, [np.empty(0, np.int64), np.empty(0, np.int64), 0])
                keys, inverse = np.unique(np.concatenate([entry[0], *once]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([entry[1], np.ones(sum(map(len, once)), np.int64)]), len(keys)).astype(np.int64)
                if len(keys) and keys[0] == 0:
                    keys, counts = keys[1:], counts[1:]
                keys, counts, cut = _shrink(keys, counts, size)
                held[source] = [keys, counts, entry[2] + cut]
        for source, (keys, counts, error) in held.items():
            # a counter of 1 is all that most lines have; key 0 carries the error of the summary
            yield pa.RecordBatch.from_arrays(
                [pa.array([source] * (len(keys) + 1), pa.string()), pa.array(np.append(keys, 0)), pa.array(np.append(counts, error))], names=["source", "key", "n"]
            )

    return run


def repeated_lines(keys: DataFrame, min_articles: int = MIN_ARTICLES, min_share: float = MIN_SHARE, summary_size: int = SUMMARY_SIZE) -> DataFrame:
    """(source, key, n_articles) of the lines repeated excessively; ``keys`` is a materialised ``line_keys``.

    The summaries never miss a line: a counter is too low by at most the error that its summary carries,
    so every line that may reach the threshold becomes a candidate, and the second pass counts it exactly.
    """
    totals = keys.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    needed = totals.select("source", F.greatest(F.lit(min_articles), F.ceil(F.col("n_rows") * F.lit(min_share) - F.lit(1e-9))).alias("needed"))
    added = keys.mapInArrow(_summaries(summary_size), "source string, key long, n long").groupBy("source", "key").agg(F.sum("n").alias("n"))
    added = materialise(added, "line-summaries")
    errors = added.where("key = 0").select("source", F.col("n").alias("error"))
    needed = materialise(needed.join(errors, "source", "left").select("source", "needed", F.coalesce("error", F.lit(0)).alias("error")), "line-needs")
    needs = bounded_broadcast(needed)
    candidates = added.where("key != 0").join(needs, "source").where("n + error >= needed").select("source", "key")
    candidates = materialise(candidates, "line-candidates")
    exact = None
    for part, mine in parts_of(candidates, "source"):
        each = keys.where(mine).select("source", "doc_id", F.explode(F.array_distinct("keys")).alias("key")).join(F.broadcast(part), ["source", "key"])
        one = each.groupBy("source", "key").agg(F.count_distinct("doc_id").alias("n_articles"))
        exact = one if exact is None else exact.unionByName(one)
    return exact.join(needs, "source").where("n_articles >= needed").select("source", "key", "n_articles")


def occurrences(keys: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, line_no): each occurrence of a repeated line, line_no from 1; ``repeated`` is materialised."""
    out = None
    for part, mine in parts_of(repeated, "source"):
        each = keys.where(mine).select("doc_id", "source", F.posexplode("keys").alias("at", "key")).where("key != 0")
        one = each.join(F.broadcast(part.select("source", "key")), ["source", "key"]).select("doc_id", (F.col("at") + 1).cast("int").alias("line_no"))
        out = one if out is None else out.unionByName(one)
    return out


Sets = dict[str, frozenset[int]]


def over_own_lines(rows: DataFrame, repeated: DataFrame, mapper: Callable[[Sets], Callable], schema: str) -> DataFrame:
    """``rows`` (with source) mapped in Arrow batches by ``mapper``, which is given the repeated lines of each source as sets.

    The sets are broadcast, ``BROADCAST_ROWS`` lines at most; more sources are taken in parts. A source holds at most
    (lines per article / min_share) repeated lines. ``repeated`` is materialised.
    """
    context = rows.sparkSession.sparkContext
    rows = rows.withColumn("source", F.coalesce("source", F.lit("")))
    out = None
    for part, mine in parts_of(repeated.select("source", "key"), "source"):
        held: dict[str, set[int]] = {}
        for source, key in part.collect():
            held.setdefault(source, set()).add(key)
        shared = context.broadcast({source: frozenset(keys) for source, keys in held.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return mapper(shared.value)(batches)

        one = rows.where(mine).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def own_lines(content: str | None, source: str, keys: LineKeys, sets: Sets) -> list[str]:
    """The lines of a text that are not repeated lines of its source."""
    if not content:
        return []
    known = sets.get(source)
    if not known:
        return content.split("\n")
    longest = keys.longest(source, known)
    remembered = keys.known.get
    out = []
    for line in content.split("\n"):
        # a line with more letters than any repeated one has need not be normalised
        if len(line) > longest and len(coded := line.encode("utf-8", "replace")) - len(coded.translate(None, _LETTERS)) > longest:
            out.append(line)
        elif (remembered(line) or keys(line)) not in known:
            out.append(line)
    return out


def without_repeated_lines(articles: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, content, n_removed): every text less its source's repeated lines; null stays null."""

    def mapper(sets: Sets):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = LineKeys()
            for batch in batches:
                texts, removed = [], []
                for text, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    lines = own_lines(text, source, keys, sets)
                    texts.append(None if text is None else "\n".join(lines))
                    removed.append(text.count("\n") + 1 - len(lines) if text else 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "content", "n_removed"])

        return run

    rows = chosen(articles, ("doc_id", "source", "content")).select("doc_id", "content", "source")
    return over_own_lines(rows, repeated, mapper, "doc_id long, content string, n_removed int")
