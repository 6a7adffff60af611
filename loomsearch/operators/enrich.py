"""Document enrichment: extractive summaries and sentiment.

Per-document algorithms run in Arrow batches; each document is on its own, so nothing is shuffled. A document whose
summary can't be made gets null, then the default text where that is asked for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import STOP_WORDS

DEFAULT_SUMMARY = "Unable to get summary."
_WORD = re.compile(r"\w+")


def _words(text: str, stop_words: frozenset[str]) -> list[str]:
    return [stem(w) for w in _WORD.findall(text.lower()) if any(c.isascii() and c.isalnum() for c in w) and w not in stop_words]


def title_sentence(title: str | None, content: str | None, skip: int = 2, stop_words: frozenset[str] = STOP_WORDS) -> str | None:
    """The sentence most like the title by cosine of TF-IDF vectors, the first ``skip`` sentences left out.

    A word's document frequency counts the sentences whose text contains it, also inside another word. The position
    is counted among the sentences that aren't empty, and read among all. None where no sentence is left.
    """
    if title is None or content is None:
        return None
    every = re.split("[.!?]", content)
    texts = [" ".join(_words(t, stop_words)) for t in [title, *[s for s in every if s][skip:]]]
    if len(texts) < 2:
        return None
    bags = []
    for text in texts:
        words = text.split()
        bags.append({w: n / len(words) for w, n in Counter(words).items()})
    wanted = set(bags[0])
    idf = {w: math.log(len(texts) / sum(w in t for t in texts)) for bag in bags for w in bag}
    vectors = [{w: f * idf[w] for w, f in bag.items()} for bag in bags]
    lengths = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    best, place = -1.0, 0
    for i, (vector, length) in enumerate(zip(vectors[1:], lengths[1:], strict=True)):
        like = sum(vectors[0][w] * vector[w] for w in wanted & vector.keys()) / (lengths[0] * length) if lengths[0] and length else 0.0
        if like > best + 1e-12:
            best, place = like, i
    return every[place + skip].strip()


def ranked_sentences(title: str | None, body: str | None, k: int = 5, damping: float = 0.85) -> str | None:
    """Title, line break and the ``k`` sentences of highest PageRank in the graph of cosine similarities; None for fewer than ``k``."""
    cleaned = re.sub(r"\s+", " ", re.sub("[’”“]", " ", body or "")).strip()
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", cleaned) if s]
    n = len(sentences)
    if n < k or not n:
        return None
    bags = [Counter(w for w in re.findall(r"[^\W\d_]+", s.lower())) for s in sentences]
    words = {w: i for i, w in enumerate(dict.fromkeys(w for bag in bags for w in bag))}
    counts = np.zeros((n, max(1, len(words))))
    for row, bag in zip(counts, bags, strict=True):
        for w, times in bag.items():
            row[words[w]] = times
    length = np.linalg.norm(counts, axis=1)
    unit = counts / np.where(length > 0, length, 1.0)[:, None]
    like = unit @ unit.T
    np.fill_diagonal(like, 0.0)
    out = like.sum(1)
    step = np.divide(like, out[:, None], out=np.full_like(like, 1.0 / n), where=out[:, None] > 0)
    rank = np.full(n, 1.0 / n)
    for _ in range(100):
        new = damping * rank @ step + (1 - damping) / n
        done = np.abs(new - rank).sum() < n * 1e-6
        rank = new
        if done:
            break
    order = sorted(range(n), key=lambda i: (-round(rank[i], 12), i))[:k]
    return f"{title or ''}\n" + "".join(sentences[i] + " " for i in order)


def title_summaries(docs: DataFrame, title: Column, content: Column, skip: int = 2) -> DataFrame:
    """(doc_id, summary)."""

    @F.pandas_udf("string")
    def summaries(titles: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([title_sentence(t, c, skip) for t, c in zip(titles, contents, strict=True)], dtype="object")

    return docs.select("doc_id", summaries(title, content).alias("summary"))


def pagerank_summaries(docs: DataFrame, title: Column, content: Column, k: int = 3) -> DataFrame:
    """(doc_id, summary)."""

    @F.pandas_udf("string")
    def summaries(titles: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([ranked_sentences(t, c, k) for t, c in zip(titles, contents, strict=True)], dtype="object")

    return docs.select("doc_id", summaries(title, content).alias("summary"))


def summary_or_default(summary: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(summary, F.lit("")), F.lit(DEFAULT_SUMMARY)))


def rounded_parts(parts: Column) -> Column:
    """Three probabilities rounded to two places, the last taking up what is missing to 1; null stays null."""
    first, second = F.round(parts[0], 2), F.round(parts[1], 2)
    return F.when(parts.isNotNull(), F.array(first, second, F.round(F.lit(1.0) - first - second, 2)))


def sentiment_entries(parts: Column) -> Column:
    """JSON list of ``label:value``; null is all neutral."""
    values = F.coalesce(parts, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    return F.to_json(F.array(*[F.concat(F.lit(f"{label}:"), F.format_string("%.2f", F.get(values, F.lit(i)))) for i, label in enumerate(("negative", "neutral", "positive"))]))


def scored_sentiment(docs: DataFrame, text: Column, scorer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(doc_id, parts): a pluggable scorer of Arrow batches gives three numbers a text, softmax and rounding are built in; null text, null parts."""
    raw = F.pandas_udf(scorer, "array<double>")(text)
    top = F.array_max(F.col("raw"))
    powers = F.transform("raw", lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    rows = docs.select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", rounded_parts(F.transform(powers, lambda x: x / total)).alias("parts"))


# A small word list for the built-in scorer; any model can take its place.
GOOD = frozenset("approved award best better celebrated good gain growth happy improve improved praised progress protect record restored success support supported thanked welcomed win won".split())
BAD = frozenset("abandoned accused attack bad blamed cancelled closed conflict crash crisis criticised cut damaged dead death delayed denied drought fear fire flood ignored injury lost poor rejected suspended worst".split())


def word_list_scorer(texts: pd.Series) -> pd.Series:
    """Scores from a word list: the share of good and bad words, against a constant for neutral."""

    def score(text: str | None) -> list[float] | None:
        if text is None:
            return None
        words = _WORD.findall(text.lower())
        n = max(1, len(words)) ** 0.5
        return [sum(w in BAD for w in words) / n, 1.0, sum(w in GOOD for w in words) / n]

    return texts.map(score)
