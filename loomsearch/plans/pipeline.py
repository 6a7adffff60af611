"""The daily job as one program: pages to new articles, records and index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import extract_pages
from ..functions.text import STOP_WORDS
from ..operators import enrich, ingest
from ..operators.postings import build_postings, first_rows, indexed_text


@dataclass
class Day:
    """What a run makes: new articles with their ids, their records, and their postings."""

    articles: DataFrame
    records: DataFrame
    postings: DataFrame


def run(pages: DataFrame, known_urls: DataFrame, start_id: int, stopping: bool = True, stemming: bool = True, stop_words: frozenset[str] = STOP_WORDS, scorer=enrich.word_list_scorer) -> Day:
    """New articles of ``pages`` (url, html, date, fetched_at): urls that aren't known, each once, numbered on in order of arrival.

    Every page becomes an article; none is held back to fill a batch.
    """
    once = first_rows(pages.where("url is not null"), ["url"], [F.asc_nulls_last("fetched_at"), F.asc_nulls_last("date")])
    fresh = once.join(known_urls.select("url").where("url is not null").distinct(), "url", "left_anti")
    numbered = ingest.assigned_ids(fresh, ["fetched_at", "url"], start_id)
    articles = extract_pages(numbered).drop("html")
    summaries = enrich.title_summaries(articles, F.col("title"), F.col("content")).withColumnRenamed("summary", "_summary")
    scores = enrich.scored_sentiment(articles, F.col("content"), scorer).select("doc_id", enrich.sentiment_entries(F.col("parts")).alias("sentiment"))
    records = ingest.records_of(articles).join(summaries, "doc_id", "left").join(scores, "doc_id", "left")
    records = records.withColumn("summary", enrich.summary_or_default(F.coalesce("_summary", "summary"))).drop("_summary")
    texts = articles.select("doc_id", indexed_text(F.col("title"), F.col("content")).alias("text"))
    return Day(articles, records, build_postings(texts, stopping, stemming, stop_words=stop_words))


def write(day: Day, out: str, name: str) -> None:
    """Writes a run's tables below ``out``, one folder per run; a run that is repeated replaces its folder."""
    day.articles.write.mode("overwrite").parquet(f"{out}/articles/run={name}")
    day.records.write.mode("overwrite").parquet(f"{out}/records/run={name}")
    day.postings.write.mode("overwrite").parquet(f"{out}/postings/run={name}")
