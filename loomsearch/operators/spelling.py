"""Spelling correction over a vocabulary table (word, count).

Candidates within an edit distance are found by their deletions: both sides are exploded into what is left after
deleting letters, joined on it, and the few that meet are measured. So no word is compared with the whole vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import deletes, deletes_of, osa, osa_distance
from .sizes import bounded_broadcast

MAX_DISTANCE = 2


def deletion_index(vocab: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(part, word, count): each word under everything that deletions leave of it; a table to be written once and looked up."""
    return vocab.where("word is not null").select("word", "count", F.explode(deletes_of("word", F.lit(distance))).alias("part"))


def candidates(words: DataFrame, vocab: DataFrame, distance: int = MAX_DISTANCE, deletions: DataFrame | None = None) -> DataFrame:
    """(query, word, count, distance): vocabulary words within the distance of each ``words.query``.

    ``deletions`` is a written ``deletion_index`` of the vocabulary for the same distance or more; without it one is made.
    A transposition counts two in the built-in distance, which leaves few pairs to be measured.
    """
    asked = words.where("query is not null").select("query").distinct()
    parts = asked.select("query", F.explode(deletes_of("query", F.lit(distance))).alias("part"))
    known = deletion_index(vocab, distance) if deletions is None else deletions
    met = known.join(bounded_broadcast(parts), "part").select("query", "word", "count").where(F.levenshtein("query", "word") <= 2 * distance).distinct()
    return met.withColumn("distance", osa_distance("query", "word")).where(F.col("distance") <= distance)


def best_words(words: DataFrame, vocab: DataFrame, distance: int = MAX_DISTANCE, deletions: DataFrame | None = None) -> DataFrame:
    """(query, word): the known word itself, else the most frequent of the nearest; the word as it is, if none is near. Ties in text order."""
    asked = words.where("query is not null").select("query").distinct()
    order = F.struct("distance", (-F.col("count")).alias("rare"), "word")
    nearest = candidates(words, vocab, distance, deletions).groupBy("query").agg(F.min(order).alias("best"))
    return asked.join(nearest, "query", "left").select("query", F.coalesce("best.word", "query").alias("word"))


def fuzzy_matches(vocab: DataFrame, query: str, max_cost: int = 2) -> DataFrame:
    """(word, count, distance): words whose Levenshtein distance to the query is below ``max_cost``, by a length band first."""
    near = vocab.where(F.abs(F.length("word") - F.lit(len(query))) <= max_cost)
    return near.select("word", "count", F.levenshtein(F.col("word"), F.lit(query)).alias("distance")).where(F.col("distance") < max_cost)


class Corrector:
    """Compound correction of a whole query on the driver, over the vocabulary rows that can matter for it.

    Words may be corrected, joined with the next one, or split in two. Words with digits, and words of one letter,
    are left alone. A query without any suggestion comes back as it is.
    """

    def __init__(self, vocab: DataFrame, max_distance: int = MAX_DISTANCE, deletions: DataFrame | None = None) -> None:
        self._vocab = vocab
        self._deletions = deletions
        self._distance = max_distance

    def _known(self, forms: Iterable[str]) -> dict[str, dict[str, int]]:
        """For each form its vocabulary words within the distance, with their counts: one plan for all forms."""
        spark = self._vocab.sparkSession
        forms = sorted(set(forms))
        if not forms:
            return {}
        rows = candidates(spark.createDataFrame([(f,) for f in forms], "query string"), self._vocab, self._distance, self._deletions).collect()
        out: dict[str, dict[str, int]] = {f: {} for f in forms}
        for row in rows:
            out[row["query"]][row["word"]] = row["count"]
        return out

    @staticmethod
    def _best(form: str, known: dict[str, int]) -> tuple[int, int, str] | None:
        ranked = sorted((osa(form, w), -n, w) for w, n in known.items())
        return ranked[0] if ranked else None

    def correct(self, text: str) -> str:
        words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text.lower())
        joined = [a + b for a, b in zip(words, words[1:], strict=False)]
        halves = [part for w in words if len(w) > 3 for i in range(2, len(w) - 1) for part in (w[:i], w[i:])]
        known = self._known([*words, *joined])
        exact = self._exact(halves)
        out: list[str] = []
        i = 0
        while i < len(words):
            word = words[i]
            best = self._best(word, known[word])
            if any(c.isdigit() for c in word) or len(word) == 1 or (best and best[0] == 0):
                out.append(word)
                i += 1
                continue
            if i + 1 < len(words):
                both = self._best(joined[i], known[joined[i]])
                following = words[i + 1]
                kept = len(following) == 1 or any(c.isdigit() for c in following)
                after = self._best(following, known[following])
                apart = (best[0] if best else self._distance + 1) + (0 if kept else after[0] if after else self._distance + 1)
                if both and both[0] + 1 < apart:
                    out.append(both[2])
                    i += 2
                    continue
            split = max(((exact[word[:k]] * exact[word[k:]], f"{word[:k]} {word[k:]}") for k in range(2, len(word) - 1) if word[:k] in exact and word[k:] in exact), default=None) if len(word) > 3 else None
            if split and (not best or best[0] > 1):
                out.append(split[1])
            else:
                out.append(best[2] if best else word)
            i += 1
        return " ".join(out) if out else text

    def _exact(self, forms: Iterable[str]) -> dict[str, int]:
        forms = sorted(set(forms))
        if not forms:
            return {}
        return {r["word"]: r["count"] for r in self._vocab.where(F.col("word").isin(*forms)).collect()}


__all__ = ["Corrector", "best_words", "candidates", "deletes", "deletion_index", "fuzzy_matches"]
