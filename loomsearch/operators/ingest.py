"""From links and pages to new articles: filters, known-url tests, ids, maps and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_day, lead, url_source, url_topic
from .postings import first_rows, numbered

#: Day that stands for a link without a readable date.
DEFAULT_DAY = "2000-01-01"


def distinct_links(links: DataFrame) -> DataFrame:
    """One row per loc: the one fetched last; ties go to the largest lastmod."""
    return first_rows(links.where("loc is not null"), ["loc"], [F.desc_nulls_last("fetched_at"), F.desc_nulls_last("lastmod"), F.asc_nulls_last("source")])


def in_sections(links: DataFrame, host: str, prefixes: list[str]) -> DataFrame:
    """Links of other hosts, and those of ``host`` that contain one of the prefixes."""
    inside = F.lit(False)
    for prefix in prefixes:
        inside = inside | F.contains("loc", F.lit(prefix))
    return links.where(~F.contains("loc", F.lit(host)) | inside)


def recent_links(links: DataFrame, today: Column, max_days: int) -> DataFrame:
    """Links not older than ``max_days``, with their day and age."""
    day = F.coalesce(any_day(F.col("lastmod")), F.lit(DEFAULT_DAY).cast("date"))
    return links.withColumn("day", day).withColumn("age_days", F.datediff(today, F.col("day"))).where(F.col("age_days") <= max_days)


def oldest_age(links: DataFrame) -> DataFrame:
    return links.agg(F.max("age_days").alias("max_age"))


def new_links(links: DataFrame, known_urls: DataFrame) -> DataFrame:
    """Links whose loc isn't a known url; null links are left out."""
    return links.where("loc is not null").join(known_urls.select(F.col("url").alias("loc")).distinct(), "loc", "left_anti")


def assigned_ids(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """Rows with contiguous doc_ids from ``start`` in the order given."""
    return numbered(rows, order, start)


# a single-quoted text ends at a quote before ``,``, ``:`` or ``}``; an apostrophe within stands before something else
_QUOTED = r"""'((?:[^'\\]|\\.|'(?!\s*[,:}]))*)'|"((?:[^"\\]|\\.)*)\""""
_PAIR = rf"(?:{_QUOTED})\s*:\s*(?:{_QUOTED})"


def decoded_map(text: Column) -> Column:
    """The map of a single-quoted text form, ``{'key': 'value'}``, where double quotes may stand as well; null for broken ones.

    Apostrophes may stand within; of a key said twice the last value counts.
    """
    whole = F.regexp_like(text, F.lit(rf"^\s*\{{\s*(?:{_PAIR}(?:\s*,\s*{_PAIR})*\s*,?)?\s*\}}\s*$"))
    either = [F.regexp_extract_all(text, F.lit(_PAIR), F.lit(i)) for i in (1, 2, 3, 4)]
    pairs = F.arrays_zip(*[e.alias(n) for e, n in zip(either, "abcd", strict=True)])
    unescaped = lambda c: F.regexp_replace(c, r"\\(['\"\\])", "$1")
    entries = F.transform(pairs, lambda p: F.struct(unescaped(F.concat(p["a"], p["b"])).alias("key"), unescaped(F.concat(p["c"], p["d"])).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.when(whole, F.map_from_entries(last))


def encoded_map(value: Column) -> Column:
    """The single-quoted text form of a map; quotes within are dropped."""
    plain = F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(F.regexp_replace(e["key"], "[\"']", "").alias("key"), F.regexp_replace(e["value"], "[\"']", "").alias("value"))))
    return F.translate(F.to_json(plain), '"', "'")


def records_of(articles: DataFrame) -> DataFrame:
    """(doc_id, url, title, date, summary, source, topic): a document record of each article."""
    return articles.select(
        "doc_id",
        "url",
        "title",
        "date",
        lead(F.col("content")).alias("summary"),
        url_source(F.col("url")).alias("source"),
        url_topic(F.col("url")).alias("topic"),
    )


def upserted(records: DataFrame, column: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """``records`` with a column set from (doc_id, name) rows where they have a value; other records keep theirs.

    Of several values of a document the last in ``order`` counts; without it, or where it is equal, the largest.
    """
    value = F.col(name)
    last = F.max(F.struct(F.col(order).alias("o"), value.alias("v")))["v"] if order else F.max(value)
    fresh = column.where(value.isNotNull()).groupBy("doc_id").agg(last.alias("_new"))
    return records.join(fresh, "doc_id", "left").withColumn(name, F.coalesce("_new", name)).drop("_new").select(*records.columns)


def merged_records(records: DataFrame, newer: DataFrame, order: str = "updated_at") -> DataFrame:
    """``records`` with whole records of ``newer`` put in: a document of both gets the newer record, of several the last in ``order``.

    Columns that ``newer`` lacks become null in its records; rows without a doc_id are left out.
    """
    both = records.withColumn("_age", F.lit(0)).unionByName(newer.where("doc_id is not null").withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in records.columns if c != "doc_id"]
    place = [F.col("_age"), *([F.col(order)] if order in both.columns else [])]
    best = both.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct(*place, F.to_json(F.struct(*rest)))).alias("r"))
    return best.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*records.columns)


def complete_articles(articles: DataFrame) -> DataFrame:
    """Articles that have both a title and a content with something but white space in them."""
    return articles.where(F.regexp_like("title", F.lit(r"\S")) & F.regexp_like("content", F.lit(r"\S")))


def clean_fragments(fragments: DataFrame) -> DataFrame:
    """One row per fragment key: the load that came last; ties prefer the indexed state and a known size."""
    return first_rows(fragments, ["source", "crawl_date", "frag_index"], [F.desc_nulls_last("loaded_at"), F.asc_nulls_last("state"), F.desc_nulls_last("n_articles")])


def late_loads(fragments: DataFrame, days: int = 3) -> DataFrame:
    """Fragments loaded more than ``days`` after their crawl."""
    return fragments.where(F.datediff(F.to_date("loaded_at"), F.col("crawl_date")) > days)
