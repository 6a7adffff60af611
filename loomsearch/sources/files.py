"""File sources and sinks.

Article fragments are CSV files named ``{source}_data_{YYYYMMDD}_{n}.csv`` with header and quoted line breaks. Names
are filtered before a file is opened; columns that a query doesn't need aren't parsed.
"""

from __future__ import annotations

import csv

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.postings import decoded, encoded, index_blocks, numbered, parsed_index

ARTICLE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "title", "date", "content", "hypertext", "figcaption", "url")] + [T.StructField("doc_id", T.LongType())])
LINK_SCHEMA = "loc string, lastmod string"
_NAME = r"([A-Za-z0-9]+)_data_(\d{8})_(\d+)\.csv$"


def list_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source, crawl_date, frag_index) of the fragment files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_data_*_*.csv").load(folder).select("path")
    parts = files.where(F.regexp_like("path", F.lit(_NAME)))
    return parts.select("path", *_name_columns(F.col("path")))


def _name_columns(path):
    return (
        F.regexp_extract(path, _NAME, 1).alias("source"),
        F.try_to_date(F.regexp_extract(path, _NAME, 2), "yyyyMMdd").alias("crawl_date"),
        F.regexp_extract(path, _NAME, 3).try_cast("int").alias("frag_index"),
    )


def read_fragments(spark: SparkSession, folder: str, source: str | None = None, date: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The articles of fragments, with crawl_date and frag_index from the file name; null texts become empty.

    ``first`` and ``last`` bound the fragment number. Source and date narrow the files that are listed.
    """
    pattern = f"{source or '*'}_data_{(date or '*').replace('-', '')}_*.csv"
    rows = _with_names(_fragment_reader(spark).option("pathGlobFilter", pattern).csv(folder))
    if first is not None:
        rows = rows.where(F.col("frag_index") >= first)
    if last is not None:
        rows = rows.where(F.col("frag_index") <= last)
    return rows.na.fill("", ["title", "date", "content", "url", "source"])


def write_fragments(articles: DataFrame, folder: str) -> None:
    """Appends articles as Parquet, one folder per source and crawl date; all rows are written."""
    articles.write.mode("append").partitionBy("source", "crawl_date").parquet(folder)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; quotes, line breaks and outer spaces are kept."""
    rows.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_fragment_csv(articles: DataFrame, folder: str, mode: str = "append") -> None:
    """Articles as CSV with header, quotes and line breaks kept; added to what the folder holds."""
    write_csv(articles, folder, mode)


def write_named_fragments(articles: DataFrame, folder: str) -> None:
    """Articles (with source, crawl_date, frag_index) as CSV files whose names tell their fragment, one file for each."""
    names = ARTICLE_SCHEMA.names
    columns = [(F.col(c) if c in articles.columns else F.lit(None)).cast("long" if c == "doc_id" else "string").alias(c) for c in names]
    wanted = articles.select(*columns, F.col("source").alias("_source"), F.date_format("crawl_date", "yyyyMMdd").alias("_day"), "frag_index")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name = f"{key[0]}_data_{key[1]}_{key[2]}.csv"
        address = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        filesystem, place = pyarrow.fs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))
        filesystem.create_dir(place, recursive=True)
        text = rows.sort_values("doc_id")[names].to_csv(index=False, quoting=csv.QUOTE_NONNUMERIC)
        with filesystem.open_output_stream(f"{place}/{name}") as out:
            out.write(text.encode())
        return pd.DataFrame({"name": [name]})

    wanted.groupBy("_source", "_day", "frag_index").applyInPandas(run, "name string").count()


def push_fragments(spark: SparkSession, source: str, target: str, fragments: list[tuple[str, str]]) -> None:
    """Adds the articles of the (source, date) pairs named from fragment files to the article table; pairs without files add nothing."""
    names = spark.createDataFrame(sorted(set(fragments)), "source string, day string").select("source", F.to_date("day").alias("crawl_date"))
    paths = [r.path for r in list_fragments(spark, source).join(F.broadcast(names), ["source", "crawl_date"], "left_semi").select("path").collect()]
    if paths:
        write_fragments(_with_names(_fragment_reader(spark).csv(paths)), target)


def _fragment_reader(spark: SparkSession):
    return spark.read.schema(ARTICLE_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True)


def _with_names(rows: DataFrame) -> DataFrame:
    _, day, number = _name_columns(F.col("_metadata.file_path"))
    return rows.withColumn("crawl_date", day).withColumn("frag_index", number)


def sources_in(spark: SparkSession, folder: str) -> DataFrame:
    """(source) of the fragment files of a folder."""
    return list_fragments(spark, folder).select("source").distinct()


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of sitemap XML files."""
    return spark.read.format("xml").option("rowTag", "url").schema(LINK_SCHEMA).load(path)


def write_index_text(postings: DataFrame, path: str) -> None:
    """The index in its text form, in term order; a term of very many documents has a line for each block of them."""
    index_blocks(postings).orderBy("term", "block").select("line").write.mode("overwrite").text(path)


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, positions, tf) of an index in its text form."""
    # a record ends before a line that isn't indented
    parts = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    term = F.when(~F.col("value").startswith("\t"), F.regexp_extract("value", r"^(.*) \d+$", 1))
    rows = parts.withColumn("term", F.last(term, ignorenulls=True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return parsed_index(rows.where(F.col("value").startswith("\t")).select(F.concat(F.col("term"), F.lit(" 1\n"), F.col("value")).alias("value")))


def write_index_json(postings: DataFrame, path: str) -> None:
    """The index as JSON lines of term, document and differences of positions."""
    encoded(postings).select("term", "doc_id", "positions").write.mode("overwrite").json(path)


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, positions, tf) of an index in its JSON form; broken lines are left out."""
    rows = spark.read.schema("term string, doc_id long, positions array<int>").json(path).where("term is not null and doc_id is not null")
    return decoded(rows).select("term", "doc_id", "positions", F.size("positions").alias("tf"))


def read_csv(spark: SparkSession, path: str, columns: str | None = None, header: bool = True) -> DataFrame:
    """Any CSV with quoted line breaks, as strings, or with the columns of a DDL text."""
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"')
    return (reader.schema(columns) if columns else reader).csv(path)


def read_numbered_csv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, body) of a CSV whose second and third columns are title and body; doc_id is the number of the row, from 0."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    _, title, body, *_ = rows.columns
    placed = rows.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"), F.col(title).alias("title"), F.col(body).alias("body"))
    return numbered(placed, ["_file", "_row"]).select("doc_id", "title", "body")


def load_words(spark: SparkSession, path: str) -> DataFrame:
    """(text, count) of a dictionary file with one word a line, or a word and its count parted by white space."""
    parts = F.regexp_extract(F.trim("value"), r"^(.*?)(?:\s+(\d+))?$", 1), F.regexp_extract(F.trim("value"), r"^(.*?)(?:\s+(\d+))?$", 2)
    return spark.read.text(path).select(F.lower(parts[0]).alias("text"), F.coalesce(parts[1].try_cast("long"), F.lit(1)).cast("long").alias("count")).where("text != ''")


def clear(spark: SparkSession, path: str) -> None:
    """Removes a table's folder; nothing happens where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of text files."""
    return spark.read.text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_corpus(docs: DataFrame, path: str, text: str = "text") -> None:
    """Texts, one a line of a text file; line breaks within become spaces, nulls are skipped."""
    docs.where(F.col(text).isNotNull()).select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, form: str = "parquet") -> None:
    """A table as Parquet, ORC, JSON or CSV."""
    writer = df.write.mode(mode).format(form)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
