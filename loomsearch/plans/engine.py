"""The search engine's interface over an index and document records."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from threading import Lock
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import boolean, corpus, expansion, ranked, results, spelling, suggest
from ..operators.postings import build_postings, doc_lengths, letter_postings
from . import query as language
from .store import IndexStore

FIELDS = ["title", "topic", "url", "source", "date", "sentiment", "summary"]


class FrequencyCache:
    """Answers kept by how often they are asked for: beyond ``size`` the one asked for least goes, of equals the one that came first."""

    def __init__(self, size: int = 2048) -> None:
        self._size = size
        self._held: dict[object, object] = {}
        self._uses: dict[object, int] = {}
        self._by_use: dict[int, OrderedDict[object, None]] = {}
        self._lock = Lock()

    def _used(self, key: object) -> None:
        n = self._uses.get(key, 0)
        if n:
            del self._by_use[n][key]
            if not self._by_use[n]:
                del self._by_use[n]
        self._uses[key] = n + 1
        self._by_use.setdefault(n + 1, OrderedDict())[key] = None

    def get(self, key: object, default: object = None) -> object:
        with self._lock:
            if key not in self._held:
                return default
            self._used(key)
            return self._held[key]

    def set(self, key: object, value: object) -> None:
        with self._lock:
            if key not in self._held and len(self._held) >= self._size:
                least = min(self._by_use)
                gone, _ = self._by_use[least].popitem(last=False)
                if not self._by_use[least]:
                    del self._by_use[least]
                del self._held[gone], self._uses[gone]
            self._held[key] = value
            self._used(key)


class ResultCache:
    """Answers by (method, query, limit, page), forgotten after ``seconds`` without use and beyond ``size`` entries."""

    def __init__(self, seconds: float = 300.0, size: int = 512, clock: Callable[[], float] = time.monotonic) -> None:
        self._seconds, self._size, self._clock = seconds, size, clock
        self._held: OrderedDict[tuple, tuple[float, object]] = OrderedDict()

    def get(self, key: tuple) -> object | None:
        entry = self._held.pop(key, None)
        if entry is None or entry[0] < self._clock():
            return None
        self._held[key] = (self._clock() + self._seconds, entry[1])
        return entry[1]

    def set(self, key: tuple, value: object) -> None:
        self._held.pop(key, None)
        self._held[key] = (self._clock() + self._seconds, value)
        while len(self._held) > self._size:
            self._held.popitem(last=False)


class SearchEngine:
    """Boolean and ranked search, suggestions, spelling and expansion over ``docs`` (doc_id, text).

    With ``store``, a written index that was built with the same options, each query is a scan of what it asks for.
    ``postings`` may be another index; without either it is built from the texts. ``records`` are document records.
    """

    def __init__(
        self,
        spark: SparkSession,
        docs: DataFrame,
        records: DataFrame | None = None,
        postings: DataFrame | None = None,
        stopping: bool = True,
        stemming: bool = True,
        stop_words: frozenset[str] = STOP_WORDS,
        store: IndexStore | None = None,
    ) -> None:
        self.spark, self.docs, self.records, self.store = spark, docs, records, store
        self.stopping, self.stemming, self.stop_words = stopping, stemming, stop_words
        self.postings = postings if postings is not None else store.postings if store else build_postings(docs, stopping, stemming, stop_words=stop_words)
        self.cache = ResultCache()
        self._n: int | None = None
        self._dictionary: DataFrame | None = None
        self._suggester: suggest.Suggester | None = None
        self._vocabulary: DataFrame | None = None
        self._model = None

    @property
    def size(self) -> int:
        """Number of documents, counted once."""
        if self._n is None:
            self._n = self.store.meta[0] if self.store else self.docs.select("doc_id").distinct().count()
        return self._n

    def validate(self, query: str) -> bool:
        return language.check(unquote(query), self.stopping, self.stemming, self.stop_words)

    def boolean(self, query: str) -> DataFrame:
        """(doc_id), in order of doc_id when paged."""
        return boolean.search(self.postings, self.docs, unquote(query), self.stopping, self.stemming, stop_words=self.stop_words)

    def boolean_batch(self, queries: list[tuple[str, str]]) -> DataFrame:
        """(query_id, doc_id) of several queries in one plan."""
        return boolean.search_batch(self.postings, self.docs, [(i, unquote(q)) for i, q in queries], self.stopping, self.stemming, self.stop_words)

    def tfidf(self, query: str) -> DataFrame:
        """(doc_id, score)."""
        query = unquote(query)
        if self.store:
            terms = ranked.query_terms(query, self.stopping, self.stemming, self.stop_words)
            scored = ranked.tfidf_known(self.postings, terms, self.store.frequencies(terms), self.size)
        else:
            scored = ranked.tfidf(self.postings, query, self.size, self.stopping, self.stemming, self.stop_words)
        return scored.withColumn("score", F.round("score", 6))

    def bm25(self, query: str, k: int = 10, included: DataFrame | None = None, stop_words: frozenset[str] = frozenset()) -> DataFrame:
        """(doc_id, score, rank) over the index of runs of letters; ``stop_words`` are left out of query and texts, none by default."""
        query = unquote(query)
        terms = [w.lower() for w in ranked._letters(query)]
        if self.store and not stop_words:
            letters, lengths = self.store.letters, self.store.lengths
        else:
            letters, lengths = letter_postings(self.docs, sorted(set(terms)), stop_words), doc_lengths(self.docs, letters_only=True, stop_words=stop_words)
        return ranked.top(ranked.bm25(letters, lengths, query, self.size, included=included, stop_words=stop_words), k)

    def page(self, found: DataFrame, number: int = 1, limit: int = 10) -> DataFrame:
        """One page of results with the fields of their documents."""
        order = [F.desc("score"), F.asc("doc_id")] if "score" in found.columns else [F.asc("doc_id")]
        rows = results.page(found, number, limit, order)
        if self.records is None:
            return rows
        return results.enriched(rows, self.records, [f for f in FIELDS if f in self.records.columns])

    def answer(self, method: str, query: str, number: int = 1, limit: int = 10) -> dict:
        """A page as rows, with the number of pages, from the cache where it is known.

        The pages within four of it are remembered by their ids, so that a neighbouring page only fetches its fields.
        """
        results.checked_request(query, number, limit)
        key = (method, query, limit, number)
        known = self.cache.get(key)
        if known is None:
            window = self.cache.get((method, query, limit, "ids", number)) or self._fetched(method, query, number, limit)
            rows = self.spark.createDataFrame(window["rows"], window["schema"])
            if self.records is not None:
                rows = results.enriched(rows, self.records, [f for f in FIELDS if f in self.records.columns])
            known = {"rows": [r.asDict() for r in rows.orderBy("rank").collect()], "total_pages": window["total_pages"]}
            self.cache.set(key, known)
        return known

    def _fetched(self, method: str, query: str, number: int, limit: int) -> dict:
        """The ids of a page; it and those around it are put into the cache."""
        found = {"boolean": self.boolean, "tfidf": self.tfidf}[method](query).persist()
        try:
            total = found.count()
            order = [F.desc("score"), F.asc("doc_id")] if "score" in found.columns else [F.asc("doc_id")]
            near = results.page_window(found, number, limit, total, order).collect()
        finally:
            found.unpersist()
        columns = found.columns
        schema = ", ".join(f"{name} {kind}" for name, kind in found.dtypes) + ", rank int"
        pages = results.page_count(total, limit)
        by_page: dict[int, list[tuple]] = {}
        for row in near:
            by_page.setdefault(row["page"], []).append(tuple(row[c] for c in columns))
        for page in {number, *by_page}:
            each = sorted(by_page.get(page, []), key=lambda r: (-r[columns.index("score")], r[columns.index("doc_id")]) if "score" in columns else r[columns.index("doc_id")])
            window = {"rows": [(*row, (page - 1) * limit + i) for i, row in enumerate(each, 1)], "schema": schema, "total_pages": pages}
            self.cache.set((method, query, limit, "ids", page), window)
        return self.cache.get((method, query, limit, "ids", number))

    def vocabulary(self) -> DataFrame:
        if self.store:
            return self.store.vocabulary
        if self._vocabulary is None:
            self._vocabulary = corpus.vocabulary(self.docs).persist()
        return self._vocabulary

    def spellcheck(self, query: str) -> str:
        return spelling.Corrector(self.vocabulary(), deletions=self.store.deletions if self.store else None).correct(unquote(query))

    def dictionary(self) -> DataFrame:
        if self._dictionary is None:
            self._dictionary = corpus.suggestion_dictionary(self.docs, self.stop_words).persist()
        return self._dictionary

    def suggest(self, query: str, size: int = 5) -> list[str]:
        if self._suggester is None:
            self._suggester = suggest.Suggester.of(self.dictionary(), stop_words=self.stop_words)
        return self._suggester.suggest(unquote(query), size)

    def expand(self, query: str, n: int = 3) -> tuple[str, list[str]]:
        results.checked_request(query, expansions=n)
        if self._model is None:
            self._model = expansion.train(self.docs)
        return expansion.expanded(self._model, unquote(query), n, self.stop_words)

    def expanded_tfidf(self, query: str, n: int = 3) -> DataFrame:
        """Ranked search with the expanded query."""
        return self.tfidf(self.expand(query, n)[0])
