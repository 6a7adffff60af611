"""A written index that sessions open: postings in term order, term statistics, the letters index and corpus tables.

A store is a folder of immutable versions; each has its tables, and a session keeps the version that it opened. What came
later is merged into a new version. Nothing but one row per asked term reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import corpus, postings, spelling

_POSTINGS = "term string, doc_id long, positions array<int>, tf int"
_STATS = "term string, df long, cf long"


class IndexStore:
    """One version of a written index."""

    def __init__(self, spark: SparkSession, path: str, version: int) -> None:
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        self._df: dict[str, int] = {}
        self._letters_df: dict[str, int] = {}

    @classmethod
    def versions(cls, spark: SparkSession, path: str) -> list[int]:
        """The finished versions of a store, oldest first."""
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        return sorted(int(n[1:]) for n in names if n[1:].isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/meta/_SUCCESS")))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IndexStore:
        """The newest version of a store."""
        known = cls.versions(spark, path)
        if not known:
            raise FileNotFoundError(path)
        return cls(spark, path, known[-1])

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, path: str, stopping: bool = True, stemming: bool = True, stop_words: frozenset[str] = STOP_WORDS) -> IndexStore:
        """Writes the index of ``docs`` (doc_id, text) as the store's next version."""
        store = cls(spark, path, (cls.versions(spark, path) or [0])[-1] + 1)
        store._write(postings.build_postings(docs, stopping, stemming, stop_words=stop_words), docs)
        return store

    def _at(self, table: str) -> str:
        return f"{self.path}/v{self.version}/{table}"

    def _write(self, rows: DataFrame, docs: DataFrame) -> None:
        postings.write_postings(rows, self._at("postings"))
        self._write_stats(self.postings, "terms")
        lengths = postings.doc_lengths(docs, letters_only=True)
        postings.write_postings(postings.letter_postings(docs), self._at("letters"))
        self._write_stats(self.letters, "letter-terms")
        lengths.write.parquet(self._at("lengths"))
        corpus.vocabulary(docs).repartitionByRange("word").sortWithinPartitions("word").write.parquet(self._at("vocabulary"))
        self._write_meta()

    def _write_stats(self, rows: DataFrame, table: str) -> None:
        postings.term_stats(rows).repartitionByRange("term").sortWithinPartitions("term").write.parquet(self._at(table))

    def _write_meta(self) -> None:
        # written last: a version without it isn't finished
        self.lengths.agg(F.count_distinct("doc_id").alias("n"), F.avg("dl").alias("average")).write.parquet(self._at("meta"))

    def updated(self, newer: DataFrame, docs: DataFrame, on_conflict: str = "last", stopping: bool = True, stemming: bool = True, stop_words: frozenset[str] = STOP_WORDS) -> IndexStore:
        """The next version with ``docs`` added; ``newer`` are their postings, or None to build them.

        Of a term and document in both, the posting of the older or the newer index is kept; lengths and counts follow the
        newer text of a document. Sessions on the former version aren't disturbed.
        """
        rows = newer if newer is not None else postings.build_postings(docs, stopping, stemming, stop_words=stop_words)
        store = IndexStore(self.spark, self.path, self.version + 1)
        postings.write_postings(postings.merged(self.postings, rows, on_conflict), store._at("postings"))
        store._write_stats(store.postings, "terms")
        ids = docs.select("doc_id").distinct()
        letters = self.letters.join(ids, "doc_id", "left_anti").unionByName(postings.letter_postings(docs).withColumn("positions", F.lit(None).cast("array<int>")))
        postings.write_postings(letters, store._at("letters"))
        store._write_stats(store.letters, "letter-terms")
        self.lengths.join(ids, "doc_id", "left_anti").unionByName(postings.doc_lengths(docs, letters_only=True)).write.parquet(store._at("lengths"))
        both = self.vocabulary.unionByName(corpus.vocabulary(docs)).groupBy("word").agg(F.sum("count").alias("count"))
        both.repartitionByRange("word").sortWithinPartitions("word").write.parquet(store._at("vocabulary"))
        store._write_meta()
        return store

    @cached_property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(self._at("postings"))

    @cached_property
    def letters(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(self._at("letters"))

    @cached_property
    def terms(self) -> DataFrame:
        return self.spark.read.schema(_STATS).parquet(self._at("terms"))

    @cached_property
    def letter_terms(self) -> DataFrame:
        return self.spark.read.schema(_STATS).parquet(self._at("letter-terms"))

    @cached_property
    def lengths(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, dl int").parquet(self._at("lengths"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.spark.read.schema("word string, count long").parquet(self._at("vocabulary"))

    @cached_property
    def deletions(self) -> DataFrame:
        """The deletion index of the vocabulary, written on its first use."""
        path = self._at("deletions")
        spelling.deletion_index(self.vocabulary).repartitionByRange("part").sortWithinPartitions("part").write.mode("ignore").parquet(path)
        return self.spark.read.schema("word string, count long, part string").parquet(path)

    @cached_property
    def meta(self) -> tuple[int, float]:
        """(documents, average length in letters' runs)."""
        row = self.spark.read.schema("n long, average double").parquet(self._at("meta")).first()
        return row.n, row.average or 1.0

    def frequencies(self, terms: Iterable[str], letters: bool = False) -> dict[str, int]:
        """The document frequencies of terms; those met before are remembered, unknown terms have 0."""
        known = self._letters_df if letters else self._df
        asked = sorted(set(terms) - known.keys())
        if asked:
            table = self.letter_terms if letters else self.terms
            found = dict(table.where(F.col("term").isin(*asked)).select("term", "df").coalesce(1).collect())
            known.update((t, found.get(t, 0)) for t in asked)
        return {t: known[t] for t in terms}
