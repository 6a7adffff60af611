"""Corpus statistics: vocabulary, bigrams, filtered corpus and the suggestion dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, bigrams, tokens, words_of_line
from ..shared import scratch
from .sizes import BROADCAST_ROWS, bounded_broadcast


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, count): occurrences of every token."""
    return docs.select(F.explode(tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def bigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(first, second, count): neighbouring words within a line; no bigram crosses lines."""
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line"))
    pairs = lines.select(F.explode(bigrams(words_of_line(F.col("line")))).alias("b"))
    return pairs.groupBy(F.col("b.first").alias("first"), F.col("b.second").alias("second")).agg(F.count(F.lit(1)).alias("count"))


def frequent_words(vocab: DataFrame, min_frequency: int) -> DataFrame:
    return vocab.where(F.col("count") > min_frequency)


#: Share of all tokens from which a word is joined by broadcast; at most 1 / share words reach it.
HOT_SHARE = 1e-4


def filtered_corpus(docs: DataFrame, vocab: DataFrame, min_frequency: int, text: str = "text") -> DataFrame:
    """(doc_id, text): each document's tokens that occur more than ``min_frequency`` times in the corpus, in order.

    If the frequent words are too many to broadcast, those that hold much of the corpus are broadcast all the same, and
    only the rest, among which none is hot, is joined by a shuffle.
    """
    each = docs.select("doc_id", F.posexplode(tokens(F.col(text))).alias("at", "word"))
    words = frequent_words(vocab, min_frequency)
    if words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = each.join(F.broadcast(words.select("word")), "word", "left_semi")
    else:
        total = vocab.agg(F.sum("count")).first()[0]
        hot = words.where(F.col("count") > total * HOT_SHARE).select("word", F.lit(True).alias("hot"))
        marked = each.join(F.broadcast(hot), "word", "left")
        rest = marked.where("hot is null").join(words.where(F.col("count") <= total * HOT_SHARE).select("word"), "word", "left_semi")
        kept = marked.where("hot").unionByName(rest)
    joined = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    return docs.select("doc_id").join(joined, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def monograms(vocab: DataFrame, stop_words: frozenset[str] = STOP_WORDS, min_length: int = 4, min_count: int = 8, divisor: int = 10) -> DataFrame:
    """(text, count): words of suggestion length that are said often, counts divided and cut."""
    rows = vocab.where((F.length("word") >= min_length) & (F.col("count") >= min_count) & ~F.col("word").isin(*sorted(stop_words)))
    return rows.select(F.col("word").alias("text"), (F.col("count") / divisor).cast("int").cast("long").alias("count"))


def suggestion_dictionary(docs: DataFrame, stop_words: frozenset[str] = STOP_WORDS, text: str = "text") -> DataFrame:
    """(text, count, kind): monograms, and bigrams said more than once whose words are both monograms."""
    spark = docs.sparkSession
    path = scratch(spark, "monograms")
    monograms(vocabulary(docs, text), stop_words).write.parquet(path)
    single = spark.read.schema("text string, count long").parquet(path)
    known = bounded_broadcast(single.select("text"))
    double = bigram_counts(docs, text).where("count > 1")
    for side in ("first", "second"):
        double = double.join(known.withColumnRenamed("text", side), side, "left_semi")
    pairs = double.select(F.concat_ws(" ", "first", "second").alias("text"), "count", F.lit("bigram").alias("kind"))
    clean = single.where(~F.regexp_like("text", F.lit("['’\"]"))).withColumn("kind", F.lit("monogram"))
    return clean.select("text", "count", "kind").unionByName(pairs)


def corpus_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """One column of texts for a text sink; nulls are skipped."""
    return docs.where(F.col(text).isNotNull()).select(F.col(text).alias("value"))


def id_ranges(artefacts: dict[str, DataFrame]) -> DataFrame:
    """(artefact, min_id, max_id, n, contiguous): what a consistency check compares."""
    out = None
    for name, df in artefacts.items():
        one = df.agg(F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), F.count_distinct("doc_id").alias("n"))
        one = one.select(F.lit(name).alias("artefact"), "min_id", "max_id", "n", F.coalesce(F.col("max_id") - F.col("min_id") + 1 == F.col("n"), F.lit(True)).alias("contiguous"))
        out = one if out is None else out.unionByName(one)
    return out
