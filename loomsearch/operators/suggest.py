"""Query suggestion over a dictionary of words and word pairs.

The dictionary is a table; a session keeps it, counted against a bound, in sorted lists on the driver, where a prefix is
a range of the list. A longer dictionary answers by filters on the table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS, node_name, node_name_of
from .sizes import bounded_broadcast

#: Entries that a session keeps on the driver.
MAX_ENTRIES = 200_000
_LIMIT = 2048


def split_synonyms(synonyms: dict[str, list[str]]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """(whole, partial): synonyms that begin with their word or are begun by it are partial, the others stand for it whole."""
    whole: dict[str, list[str]] = {}
    partial: dict[str, list[str]] = {}
    for word, others in synonyms.items():
        for other in others:
            near = other != word and (other.startswith(word) or word.startswith(other))
            (partial if near else whole).setdefault(word, []).append(other)
    return whole, partial


def with_synonyms(dictionary: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(text, count): the dictionary with the synonyms (word, synonym) of its words, each with its word's count; known texts keep theirs."""
    named = synonyms.where("word is not null and synonym is not null").join(dictionary.select(F.col("text").alias("word"), "count"), "word")
    both = dictionary.select("text", "count", F.lit(0).alias("age")).unionByName(named.select(F.col("synonym").alias("text"), "count", F.lit(1).alias("age")))
    return both.groupBy("text").agg(F.min(F.struct("age", (-F.col("count")).alias("n"))).alias("b")).select("text", (-F.col("b.n")).alias("count"))


def word_contexts(dictionary: DataFrame, words: DataFrame, size: int = 5) -> DataFrame:
    """(word, rank, text, count): for each of ``words`` (word) the most frequent longer entries that hold it as a whole word."""
    asked = words.where("word is not null").select("word").distinct()
    parts = dictionary.where(F.contains("text", F.lit(" "))).select("text", "count", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    met = parts.join(bounded_broadcast(asked), "word")
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("count"), "text"))
    return met.withColumn("rank", rank).where(F.col("rank") <= size).select("word", "rank", "text", "count")


def flat_tokens(found: Iterable[Iterable[str]]) -> list[str]:
    """The words of lists of words, each once, in order."""
    return list(dict.fromkeys(w for words in found for entry in words for w in entry.split()))


def by_prefix(dictionary: DataFrame, prefix: str, size: int = 5) -> DataFrame:
    """(text, count): the most frequent entries that begin with the prefix, itself left out; one more than ``size``."""
    rows = dictionary.where(F.col("text").startswith(prefix) & (F.col("text") != prefix))
    return rows.select("text", "count").orderBy(F.desc("count"), "text").limit(size + 1)


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


class Suggester:
    """Suggestions for a query that is being typed.

    ``entries`` are (text, count) in dictionary order: the order in which near words are tried. Prefixes are looked
    up among single words, unless ``index_pairs``; near words are sought among all entries.
    """

    def __init__(self, entries: Iterable[tuple[str, int]], stop_words: frozenset[str] = STOP_WORDS, index_pairs: bool = False, synonyms: dict[str, list[str]] | None = None) -> None:
        self.words: dict[str, int] = dict(entries)
        self._stop = stop_words
        self._names = {name: word for word in reversed(self.words) if (index_pairs or " " not in word) and (name := node_name_of(word))}
        self._back: dict[str, str] = {}
        for word, others in (synonyms or {}).items():
            for other in others:
                self._back[other] = word
                if name := node_name_of(other):
                    self._names.setdefault(name, other)
        self._sorted = sorted(self._names)
        self.search = lru_cache(maxsize=_LIMIT)(self._search)

    @classmethod
    def of(cls, dictionary: DataFrame, **options) -> Suggester:
        """From a dictionary table: most frequent entries first, ties in text order; beyond the bound, the table is asked."""
        rows = dictionary.select("text", "count").orderBy(F.desc("count"), "text").limit(MAX_ENTRIES + 1).collect()
        if len(rows) > MAX_ENTRIES:
            return TableSuggester(dictionary, **options)
        return cls(((r["text"], r["count"]) for r in rows), **options)

    def count_of(self, word: str) -> int | None:
        return self.words.get(node_name_of(word))

    def set_count(self, word: str, count: int) -> None:
        """Sets the count of a known word; answers that were remembered are forgotten."""
        if word in self.words:
            self.words[word] = count
            self.search.cache_clear()

    def _range(self, prefix: str) -> tuple[int, int]:
        return bisect_left(self._sorted, prefix), bisect_left(self._sorted, prefix + "\U0010ffff")

    def below(self, prefix: str, size: int) -> list[str]:
        """The words that go on from a prefix, most frequent first, ties shorter and earlier first; one more than ``size``."""
        low, high = self._range(prefix)
        names = [n for n in self._sorted[low:high] if n != prefix]
        names.sort(key=lambda n: (-self.words.get(self._names[n], 0), len(n), n))
        return [self._names[n] for n in names[: size + 1]]

    def _reach(self, text: str) -> tuple[int, set[str]]:
        """(letters, names): how far into a text some word goes on, and the names of words that the text begins with."""
        end, names = 0, set()
        while end < len(text):
            low, high = self._range(text[: end + 1])
            if low == high:
                break
            end += 1
            if text[:end] in self._names:
                names.add(text[:end])
        return end, names

    def _word(self, name: str) -> str:
        return self._names[name]

    def walk(self, text: str) -> tuple[list[str], str, str]:
        """(words, prefix, rest): the dictionary words a text begins with, the prefix reached after them, and what is left.

        The text is read letter by letter as long as some word goes on that way; a word is taken where it ends before a
        space or the end. Reading begins anew after each word.
        """
        words: list[str] = []
        at = 0
        while at < len(text):
            if text[at] == " ":
                at += 1
                continue
            letters, names = self._reach(text[at:])
            end = at + letters
            taken = max((at + len(n) for n in names if text[at + len(n) : at + len(n) + 1] in ("", " ")), default=None)
            if taken is None:
                return words, text[at:end], text[end:]
            word = self._word(text[at:taken])
            if words and word.startswith(words[-1]):
                words.pop()
            if word not in words:
                words.append(word)
            at = taken
        return words, "", ""

    def _entries(self, word: str, max_cost: int, size: int) -> Iterable[str]:
        """The entries that may be near to a word, in dictionary order."""
        return self.words

    def _near(self, word: str, max_cost: int, size: int) -> tuple[int, list[str]]:
        """The entries nearest to a word: tried in dictionary order, ending at the first that is closer than 2."""
        found: dict[int, list[str]] = {}
        n = 0
        for entry in self._entries(word, max_cost, size):
            if abs(len(entry) - len(word)) > max_cost:
                continue
            distance = levenshtein(word, entry)
            if distance < max_cost:
                found.setdefault(distance, []).append(entry)
                n += 1
                if n >= size or distance < 2:
                    break
        least = min(found, default=0)
        return least, found.get(least, [])

    def _find(self, text: str, max_cost: int, size: int, again: bool = True) -> dict[int, list[list[str]]]:
        """Lists of words by distance."""
        out: dict[int, list[list[str]]] = {}
        words, prefix, rest = self.walk(text)
        if words:
            out[0] = [list(words)]
            if words[-1] in self._stop and not prefix:
                return out
        if len(rest) < 3:
            start = prefix or (node_name_of(words[-1]) if words else "")
            head = words if prefix else words[:-1]
            if start or not text:
                out.setdefault(1, []).extend([*head, w] for w in self.below(start, size))
            return out
        chunks = [c for c in (prefix + rest).split(" ") if c]
        new = chunks.pop(0)
        while len(new) < 5 and chunks:
            new = f"{new} {chunks.pop(0)}"
        least, near = self._near(new, max_cost, size)
        tails: dict[int, list[list[str]]] = self._find(" ".join(chunks), max_cost, size, False) if near and chunks and again else {}
        for entry in near:
            if tails:
                out.setdefault(least, []).extend([*words, entry, *tail] for tail in tails[min(tails)])
            else:
                out.setdefault(least, []).append([*words, entry])
                out[least].extend([*words, w] for w in self.below(node_name_of(entry), size))
        if words and sum(map(len, out.values())) < size:
            out.setdefault((least if near else 0) + 1, []).extend([*words[:-1], w] for w in self.below(node_name_of(words[-1]), size))
        return out

    def _search(self, word: str, max_cost: int = 2, size: int = 5) -> tuple[tuple[str, ...], ...]:
        """Up to ``size`` different lists of words, nearest first."""
        text = node_name_of(word)
        if not text:
            return ()
        found = self._find(text, max_cost, size)
        out: dict[tuple[str, ...], None] = {}
        for distance in sorted(found):
            for words in found[distance]:
                if words:
                    out[tuple(self._back.get(w, w) for w in words)] = None
        return tuple(list(out)[:size])

    def suggest(self, query: str, size: int = 5) -> list[str]:
        """Whole queries: the last two words that aren't stop words are completed, or the last one if that finds nothing."""
        words = [w for w in query.split() if w not in self._stop]
        cut = max(0, len(words) - 2)
        answer = self.search(" ".join(words[cut:]), 2, size)
        if not answer and len(words) > 1:
            cut = len(words) - 1
            answer = self.search(words[-1], 2, 5)
        head = " ".join(words[:cut])
        seen: set[str] = set()
        out = []
        for found in answer:
            # words after the first are not said again in another suggestion
            tail = [w for w in found[1:] if w not in seen]
            seen.update(found[1:])
            out.append(" ".join([head, " ".join([found[0], *tail][:2] if len(found) > 1 else found)]))
        return out


class TableSuggester(Suggester):
    """Suggestions from a dictionary table too long for the driver: each step of a search is a filter on the whole table."""

    def __init__(self, dictionary: DataFrame, stop_words: frozenset[str] = STOP_WORDS, index_pairs: bool = False, synonyms: dict[str, list[str]] | None = None) -> None:
        super().__init__((), stop_words, index_pairs, synonyms)
        # the order in which near words are tried stays when counts are set
        self._table = dictionary.select("text", "count", F.col("count").alias("order"), node_name(F.col("text")).alias("name")).persist()
        self._pairs = index_pairs

    def _named(self) -> DataFrame:
        return self._table.where("name != ''" if self._pairs else "name != '' and not contains(text, ' ')")

    def count_of(self, word: str) -> int | None:
        row = self._table.where(F.col("text") == node_name_of(word)).select("count").first()
        return row["count"] if row else None

    def set_count(self, word: str, count: int) -> None:
        self._table = self._table.withColumn("count", F.when(F.col("text") == word, F.lit(count)).otherwise(F.col("count")))
        self.search.cache_clear()

    def below(self, prefix: str, size: int) -> list[str]:
        rows = self._named().where(F.col("name").startswith(prefix) & (F.col("name") != prefix))
        # of entries with one name the first in dictionary order
        rows = rows.groupBy("name").agg(F.min(F.struct((-F.col("order")).alias("o"), "text", "count")).alias("e"))
        best = rows.select("name", "e.text", "e.count").orderBy(F.desc("count"), F.length("name"), "name").limit(size + 1).collect()
        found = {r["name"]: (-r["count"], len(r["name"]), r["name"], r["text"]) for r in best}
        low, high = self._range(prefix)
        for name in self._sorted[low:high]:
            if name != prefix and name not in found and self._first(name) is None:
                found[name] = (0, len(name), name, self._names[name])
        return [entry[3] for entry in sorted(found.values())[: size + 1]]

    def _first(self, name: str) -> str | None:
        row = self._named().where(F.col("name") == name).orderBy(F.desc("order"), "text").select("text").first()
        return row["text"] if row else None

    def _word(self, name: str) -> str:
        return self._first(name) or self._names[name]

    def _reach(self, text: str) -> tuple[int, set[str]]:
        starts = [text[:k] for k in range(1, len(text) + 1)]
        name = F.col("name")
        rows = self._named().where(name.startswith(text[0]))
        furthest = F.max(F.greatest(F.lit(0), *[F.when(name.startswith(s), F.lit(len(s))).otherwise(F.lit(0)) for s in starts]))
        letters, names = rows.agg(furthest, F.collect_set(F.when(name.isin(*starts), name))).first()
        more, others = super()._reach(text)
        return max(letters or 0, more), set(names) | others

    def _entries(self, word: str, max_cost: int, size: int) -> Iterable[str]:
        near = (F.abs(F.length("text") - len(word)) <= max_cost) & (F.levenshtein(F.col("text"), F.lit(word)) < max_cost)
        return [r["text"] for r in self._table.where(near).orderBy(F.desc("order"), "text").select("text").limit(size).collect()]
