"""What is done with results: pages, metadata, filters and facets."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import any_day
from .postings import first_rows
from .sizes import bounded_broadcast


def checked_request(query: str, page: int = 1, limit: int = 10, expansions: int = 3) -> None:
    """Raises ValueError for a request outside the bounds of the interface."""
    if not 1 <= len(query) <= 1024:
        raise ValueError("a query has 1 to 1024 characters")
    if page < 1 or not 1 <= limit <= 100 or not 1 <= expansions <= 10:
        raise ValueError("page is 1 or more, limit 1 to 100, expansions 1 to 10")


def page_count(n: int, limit: int) -> int:
    return ceil(n / limit)


def page(results: DataFrame, number: int, limit: int, order: list[Column]) -> DataFrame:
    """Rows of one page with their rank; a page beyond the last is empty."""
    first = (number - 1) * limit
    rows = results.orderBy(*order).offset(first).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + F.lit(first))


def page_window(results: DataFrame, number: int, limit: int, total: int, order: list[Column], reach: int = 4) -> DataFrame:
    """The ids of the pages within ``reach`` of a page, with their page number."""
    low, high = max(1, number - reach), min(page_count(total, limit), number + reach)
    if high < low:
        return results.limit(0).withColumn("page", F.lit(0))
    rows = results.orderBy(*order).offset((low - 1) * limit).limit((high - low + 1) * limit)
    rank = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn("page", (F.floor(rank / limit) + low).cast("int"))


def document_records(raw: DataFrame) -> DataFrame:
    """One record per document of a table with repeated and older versions: the latest; ties go to the longest summary, then in text order."""
    order = [F.desc_nulls_last("updated_at"), F.desc_nulls_last(F.length("summary")), F.asc_nulls_last("summary"), F.asc_nulls_last("sentiment"), F.asc_nulls_last("title")]
    return first_rows(raw.where("doc_id is not null"), ["doc_id"], order)


def enriched(page_rows: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """A page's rows with fields of their documents, null where there is no record; only the page's ids meet the records."""
    ids = bounded_broadcast(page_rows.select("doc_id").distinct(), 10_000)
    side = records.join(ids, "doc_id", "left_semi").select("doc_id", *fields)
    return page_rows.join(side, "doc_id", "left")


def sentiment_parts(json: Column) -> Column:
    """Map of label to value of a list of ``label:value`` strings; values of a label said twice are added, broken entries count 0."""
    entries = F.from_json(json, "array<string>")

    def total(label: str) -> Column:
        mine = F.filter(entries, lambda e: F.split(e, ":")[0] == label)
        return F.aggregate(mine, F.lit(0.0), lambda s, e: s + F.coalesce(F.get(F.split(e, ":"), F.lit(1)).try_cast("double"), F.lit(0.0)))

    return F.struct(*[F.coalesce(total(x), F.lit(0.0)).alias(x) for x in ("negative", "neutral", "positive")])


def sentiment_label(parts: Column) -> Column:
    """The label of the largest of the parts negative, neutral and positive; of equal ones the first."""
    values = F.array(*[F.struct(F.coalesce(parts[k], F.lit(0.0)).alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(("negative", "neutral", "positive"))])
    return F.array_max(values)["k"]


def with_sentiment(rows: DataFrame, wanted: str, parts: Column) -> DataFrame:
    """Rows whose strictly largest part is ``wanted``; ties match nothing."""
    others = [x for x in ("negative", "neutral", "positive") if x != wanted]
    return rows.where((parts[wanted] > parts[others[0]]) & (parts[wanted] > parts[others[1]]))


def in_year(rows: DataFrame, year: int, date: Column) -> DataFrame:
    return rows.where(F.year(any_day(date)) == year)


def of_source(rows: DataFrame, source: str) -> DataFrame:
    return rows.where(F.col("source") == source)


def facet(rows: DataFrame, column: str = "source") -> DataFrame:
    """The distinct values of a column with their number of rows."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
