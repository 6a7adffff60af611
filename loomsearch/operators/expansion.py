"""Query expansion by word vectors: skip-gram with negative sampling, trained in Arrow batches, the vectors a table.

Nothing that grows with the vocabulary is sent to the driver or broadcast: a task has the vectors of the words that its texts
hold, and the driver those of a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stem import stem
from ..functions.text import STOP_WORDS, analysed
from ..shared import scratch
from ..shipping import ship

#: Texts for which there is a task at least, about.
PARTITION_TEXTS = 2_000
#: Words, and different words, of which a task trains vectors together; two numbers a dimension are held for each of the latter.
PART_WORDS = 4_000_000
PART_VOCABULARY = 100_000
#: Words that are taken in at once.
_STEP_WORDS = 100_000
#: The first rate of learning and the last, and the negative words of each pair.
_RATES = (0.025, 0.0001)
_NEGATIVE = 5
#: Words whose pairs are summed before the vectors change, in blocks that are multiplied at once; negative words that they share.
_CHUNK = 512
_BLOCK = 32
_SHARED = 64


@dataclass
class WordVectors:
    """(word, vector) rows."""

    vectors: DataFrame

    def getVectors(self) -> DataFrame:
        return self.vectors

    def synonyms(self, words: list[str], n: int) -> dict[str, list[str]]:
        """The ``n`` nearest words by the cosine, nearest first, of each of ``words`` that has a vector; all in one pass."""
        asked = {r.word: np.array(r.vector, np.float32) for r in self.vectors.where(F.col("word").isin(*words)).collect()} if words else {}
        if not asked or n < 1:
            return {w: [] for w in asked}
        names = list(asked)
        sides = _unit(np.stack([asked[w] for w in names]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[float, str]]] = [[] for _ in names]
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = np.round((sides @ _unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)).T).astype(np.float64), 6)
                for k, row in enumerate(near):
                    # one more, as a word is nearest to itself; all that are as near as the last are kept for the order of ties
                    least = -np.inf if len(row) <= n + 1 else np.partition(row, len(row) - n - 1)[len(row) - n - 1]
                    rows = np.flatnonzero(row >= least)
                    found = zip((-row[rows]).tolist(), batch.column(0).take(pa.array(rows)).to_pylist(), strict=True)
                    best[k] = sorted([*best[k], *(x for x in found if x[1] != names[k])])[:n]
            rows = [(name, word, -score) for name, found in zip(names, best, strict=True) for score, word in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["asked", "word", "near"])

        place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("near"), "word"))
        found = self.vectors.select("word", "vector").mapInArrow(run, "asked string, word string, near double").withColumn("place", place).where(F.col("place") <= n)
        out: dict[str, list[str]] = {w: [] for w in names}
        for r in sorted(found.collect(), key=lambda r: r.place):
            out[r.asked].append(r.word)
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def saved(model: WordVectors, path: str) -> None:
    """Writes a model to a folder, which ``loaded`` reads."""
    model.vectors.write.mode("overwrite").parquet(path)


def loaded(path: str) -> WordVectors:
    return WordVectors(SparkSession.builder.getOrCreate().read.schema("word string, vector array<float>").parquet(path))


def _first_vectors(words: list[str], size: int, seed: int) -> np.ndarray:
    """Small numbers that follow from the word and the seed, so that every task begins with the same."""
    x = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (((x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)) - np.float32(0.5)) / np.float32(size)


def _falling(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e^x), in the place of ``x``."""
    np.exp(np.minimum(x, 30, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _add_rows(to: np.ndarray, ids: np.ndarray, change: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """Adds changes to the rows of ``ids``; where very many pairs come together in a row, no more than a step that can't overshoot."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    total = np.add.reduceat(weight[order], starts)
    to[ids[starts]] += np.add.reduceat(change[order], starts, axis=0) * (rate * np.minimum(1, 1 / np.maximum(rate * total, 1e-12)))[:, None].astype(np.float32)


def trained(ids: np.ndarray, lengths: np.ndarray, vectors: np.ndarray, window: int, iterations: int, seed: int) -> np.ndarray:
    """``vectors`` after ``iterations`` passes over texts of ``lengths`` words, which stand one after the other in ``ids``.

    As word2vec's skip-gram: each word gives those up to a drawn distance from it, against negative words drawn by the
    frequencies to the power 0.75. Pairs of a block of words are products of matrices.
    """
    rng = np.random.default_rng(seed)
    size = vectors.shape[1]
    others = np.zeros_like(vectors)
    drawn = np.cumsum(np.bincount(ids, minlength=len(vectors)) ** 0.75)
    text = np.repeat(np.arange(len(lengths)), lengths)
    pad = window + -len(ids) % _BLOCK
    ids_at = np.concatenate([np.zeros(window, ids.dtype), ids, np.zeros(pad, ids.dtype)])
    text_at = np.concatenate([np.full(window, -1), text, np.full(pad, -1)])
    wide = _BLOCK + 2 * window
    apart = np.abs(np.arange(wide)[None, :] - np.arange(_BLOCK)[:, None] - window)
    steps = iterations * len(ids)
    for done in range(iterations):
        for a in range(0, len(ids_at) - 2 * window, _CHUNK):
            b = min(a + _CHUNK, len(ids_at) - 2 * window)
            n, blocks = b - a, (b - a) // _BLOCK
            rate = max(_RATES[1], _RATES[0] * (1 - (done * len(ids) + a) / steps))
            mine, around = ids_at[a + window : b + window], ids_at[a : b + 2 * window]
            x, y = vectors[mine], others[around]
            texts = text_at[a : b + 2 * window]
            reach = np.where(texts[window : window + n] < 0, 0, rng.integers(1, window + 1, n)).reshape(blocks, _BLOCK, 1)
            near = np.lib.stride_tricks.sliding_window_view(texts, wide)[::_BLOCK]
            pairs = (apart[None] <= reach) & (apart[None] > 0) & (texts[window : window + n].reshape(blocks, _BLOCK, 1) == near[:, None, :])
            x_of, y_of = x.reshape(blocks, _BLOCK, size), np.lib.stride_tricks.as_strided(y, (blocks, wide, size), (_BLOCK * y.strides[0], *y.strides))
            pull = _falling(x_of @ y_of.transpose(0, 2, 1)) * pairs
            change = (pull @ y_of).reshape(n, size)
            of_blocks = pull.transpose(0, 2, 1) @ x_of
            theirs, weight = np.zeros_like(y), np.zeros(len(y))
            for k in range(blocks):
                theirs[k * _BLOCK : k * _BLOCK + wide] += of_blocks[k]
                weight[k * _BLOCK : k * _BLOCK + wide] += pairs[k].sum(axis=0)
            count = pairs.sum(axis=2, dtype=np.float32).ravel()
            against = np.searchsorted(drawn, rng.random(_SHARED) * drawn[-1], "right")
            z = others[against]
            # a negative word that is the word itself counts for nothing
            push = _falling(-(x @ z.T)) * (count * np.float32(_NEGATIVE / _SHARED))[:, None] * (mine[:, None] != against)
            change -= push @ z
            _add_rows(vectors, mine, change, count * (1.0 + _NEGATIVE), rate)
            _add_rows(others, np.concatenate([around, against]), np.concatenate([theirs, -(push.T @ x)]), np.concatenate([weight, np.full(_SHARED, count.sum() * _NEGATIVE / _SHARED)]), rate)
    return vectors


def _frequent(rows: DataFrame, min_count: int) -> DataFrame:
    """(words) rows with only the words that occur ``min_count`` times in all."""
    each = rows.select(F.monotonically_increasing_id().alias("row"), "words").select("row", F.posexplode("words").alias("at", "word"))
    kept = each.join(each.groupBy("word").count().where(F.col("count") >= min_count).select("word"), "word", "left_semi")
    return kept.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words")).select("words")


def train(docs: DataFrame, text: str = "text", size: int = 200, window: int = 10, min_count: int = 1, seed: int = 7, partitions: int | None = None, iterations: int = 1) -> WordVectors:
    """Vectors of the words left after stop words are taken out.

    Each task trains on its texts, ``PART_WORDS`` words at a time and ``iterations`` times each; the vectors of a word are
    averaged by how often it was there. Without ``partitions`` texts stay where they lie, unless they lie in too few partitions.
    """
    spark = ship(docs.sparkSession)
    if partitions is None:
        wanted = max(1, -(-docs.count() // PARTITION_TEXTS))
        partitions = wanted if docs.rdd.getNumPartitions() < min(wanted, spark.sparkContext.defaultParallelism) else None
    rows = docs.select(F.col(text))
    rows = (rows.repartition(partitions) if partitions else rows).select(analysed(F.col(text)).alias("words")).where(F.size("words") > 0)
    if min_count > 1:
        rows = _frequent(rows, min_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        ids, lengths, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            words, every = list(known), np.concatenate(ids)
            counts = np.bincount(every, minlength=len(words))
            vectors = trained(every, np.concatenate(lengths), _first_vectors(words, size, seed), window, iterations, seed)
            for a in range(0, len(words), 10_000):
                part = vectors[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 10_000], pa.string()), pa.array(counts[a : a + 10_000]), pa.array([v.tobytes() for v in part], pa.binary())], names=["word", "n", "vector"])

        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            cuts = np.unique(np.searchsorted(offsets, np.arange(offsets[0], offsets[-1], _STEP_WORDS)[1:]))
            for a, b in zip([0, *cuts], [*cuts, len(offsets) - 1], strict=True):
                if b <= a:
                    continue
                coded = lists.values.slice(offsets[a], offsets[b] - offsets[a]).dictionary_encode()
                code = np.fromiter((known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
                ids.append(code[coded.indices.to_numpy()])
                lengths.append(np.diff(offsets[a : b + 1]))
                held += len(ids[-1])
                if held >= PART_WORDS or len(known) >= PART_VOCABULARY:
                    yield from out()
                    known, ids, lengths, held = {}, [], [], 0
        if held:
            yield from out()

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, float, np.ndarray] | None = None

        def rows_of(words: list[str], n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            values = pa.array((sums / n[:, None]).astype(np.float32).ravel())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size), pa.int32()), values)], names=["word", "vector"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64)
            sums = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, size) * n[:, None]
            starts = [k for k, w in enumerate(words) if not k or w != words[k - 1]]
            words, n, sums = [words[k] for k in starts], np.add.reduceat(n, starts), np.add.reduceat(sums, starts, axis=0)
            if last and last[0] == words[0]:
                n[0] += last[1]
                sums[0] += last[2]
            elif last:
                yield rows_of([last[0]], np.array([last[1]]), last[2][None])
            # the last word may go on in the next batch
            last = (words[-1], n[-1], sums[-1].copy())
            if len(words) > 1:
                yield rows_of(words[:-1], n[:-1], sums[:-1])
        if last:
            yield rows_of([last[0]], np.array([last[1]]), last[2][None])

    path = scratch(spark, "word-vectors")
    rows.mapInArrow(run, "word string, n long, vector binary").repartition("word").sortWithinPartitions("word").mapInArrow(average, "word string, vector array<float>").write.parquet(path)
    return loaded(path)


def expanded(model: WordVectors, query: str, n: int = 3, stop_words: frozenset[str] = STOP_WORDS) -> tuple[str, list[str]]:
    """The query with up to ``n`` similar words per term, and the words added; no stem is said twice, unknown terms add nothing."""
    kept: list[str] = []
    added: list[str] = []
    stems: set[str] = set()
    words = [word for word in query.lower().split() if word not in stop_words]
    similar = model.synonyms(list(dict.fromkeys(words)), n)
    for word in words:
        if stem(word) not in stems:
            stems.add(stem(word))
            kept.append(word)
        for other in similar.get(word, []):
            if stem(other) not in stems:
                stems.add(stem(other))
                kept.append(other)
                added.append(other)
    return " ".join(kept), added
