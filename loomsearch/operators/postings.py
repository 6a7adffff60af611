"""The positional inverted index as DataFrames.

``postings(term, doc_id, positions, tf)`` has one row per term and document. Positions count from 1 over the analysed
tokens, after stop words are taken out. Null texts have no postings; a null term never occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codec import delta_decoded, delta_encoded
from ..functions.stem import stemmed
from ..functions.text import STOP_WORDS, alpha_tokens, analysed, without_stop_words
from ..shared import scratch


def indexed_text(title: Column, content: Column) -> Column:
    """The string that is indexed: title, line break, content."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))


def build_postings(docs: DataFrame, stopping: bool = True, stemming: bool = False, terms: list[str] | None = None, stop_words: frozenset[str] = STOP_WORDS, text: str = "text") -> DataFrame:
    """The index of ``docs`` (doc_id and a text column); with ``terms``, only their postings.

    Documents are spread by doc_id before they are cut into tokens, so that grouping by document and term needs no
    further exchange and the texts, not their tokens, are shuffled. A term in every document is no hot key.
    """
    texts = docs.select("doc_id", F.col(text).alias("text"))
    if terms is None or stemming:
        texts = texts.repartition("doc_id")
    words = texts.select("doc_id", analysed(F.col("text"), stopping, stop_words).alias("words"))
    if stemming:
        words = words.select("doc_id", stemmed("words").alias("words"))
    if terms is not None and not stemming:
        # few tokens are wanted: they are picked before they become rows, and only they are shuffled
        placed = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("term")))
        each = words.select("doc_id", F.explode(F.filter(placed, lambda x: x["term"].isin(*terms) if terms else F.lit(False))).alias("x")).select("doc_id", "x.at", "x.term")
    else:
        each = words.select("doc_id", F.posexplode("words").alias("at", "term"))
    if terms is not None and stemming:
        each = each.where(F.col("term").isin(*terms))
    grouped = each.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list((F.col("at") + 1).cast("int"))).alias("positions"))
    return grouped.select("term", "doc_id", "positions", F.size("positions").alias("tf"))


def write_postings(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes the index in term order, so that a lookup of terms reads the row groups that hold them only.

    Ranges follow term and document, so a term of very many documents spreads over several files.
    """
    ordered = postings.repartitionByRange(partitions, "term", "doc_id") if partitions else postings.repartitionByRange("term", "doc_id")
    ordered.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def letter_postings(docs: DataFrame, terms: list[str] | None = None, stop_words: frozenset[str] = frozenset(), text: str = "text") -> DataFrame:
    """(term, doc_id, tf) over runs of letters: the index of BM25. Without ``stop_words`` every run counts."""
    texts = docs.select("doc_id", F.col(text).alias("text"))
    if terms is None:
        texts = texts.repartition("doc_id")
    words = texts.select("doc_id", F.explode(without_stop_words(alpha_tokens(F.col("text")), stop_words)).alias("term"))
    if terms is not None:
        words = words.where(F.col("term").isin(*terms))
    return words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def doc_lengths(docs: DataFrame, text: str = "text", letters_only: bool = False, stopping: bool = True, stop_words: frozenset[str] | None = None) -> DataFrame:
    """(doc_id, dl): the number of indexed tokens of each document; of runs of letters, those of ``letter_postings`` with the same stop words."""
    if letters_only:
        words = without_stop_words(alpha_tokens(F.col(text)), stop_words or frozenset())
    else:
        words = analysed(F.col(text), stopping, STOP_WORDS if stop_words is None else stop_words)
    return docs.select("doc_id", F.size(words).alias("dl"))


def index_meta(docs: DataFrame) -> DataFrame:
    """(document_size, min_doc_id, max_doc_id): one row."""
    return docs.agg(F.count_distinct("doc_id").alias("document_size"), F.min("doc_id").alias("min_doc_id"), F.max("doc_id").alias("max_doc_id"))


def merged(older: DataFrame, newer: DataFrame, on_conflict: str = "first") -> DataFrame:
    """Two indices in one; of a term and document in both, the older (``first``) or newer (``last``) posting is kept.

    The choice is an aggregate, not a window, so it is combined before the shuffle.
    """
    if on_conflict not in ("first", "last"):
        raise ValueError("on_conflict is 'first' or 'last'")
    both = older.select("term", "doc_id", "positions", F.lit(0).alias("age")).unionByName(newer.select("term", "doc_id", "positions", F.lit(1).alias("age")))
    choose = F.min_by if on_conflict == "first" else F.max_by
    kept = both.groupBy("term", "doc_id").agg(choose("positions", "age").alias("positions"))
    return kept.select("term", "doc_id", "positions", F.size("positions").alias("tf"))


def encoded(postings: DataFrame) -> DataFrame:
    """Positions as differences."""
    return postings.withColumn("positions", delta_encoded(F.col("positions")))


def decoded(postings: DataFrame) -> DataFrame:
    return postings.withColumn("positions", delta_decoded(F.col("positions")))


def clean_postings(raw: DataFrame) -> DataFrame:
    """Postings of a loaded table with repeated rows, split rows, and terms in other case or with outer spaces.

    Rows of null terms or documents are left out; positions are distinct and ascending.
    """
    rows = raw.where("term is not null and doc_id is not null").select(F.lower(F.trim("term")).alias("term"), "doc_id", "positions")
    joined = rows.groupBy("term", "doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    return joined.select("term", "doc_id", "positions", F.size("positions").alias("tf"))


def index_lines(postings: DataFrame) -> DataFrame:
    """(term, line): the text form of the index, ``term df`` and one tab-indented ``doc: p1,p2`` line per document.

    A term's documents are gathered in one row: the form is meant for inspection; the table itself is the index.
    """
    lines = postings.select("term", "doc_id", F.concat(F.lit("\t"), F.col("doc_id"), F.lit(": "), F.array_join("positions", ",")).alias("entry"))
    grouped = lines.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sort_array(F.collect_list(F.struct("doc_id", "entry"))).alias("entries"))
    return grouped.select("term", F.concat_ws("\n", F.concat_ws(" ", "term", F.col("df").cast("string")), F.array_join(F.col("entries.entry"), "\n")).alias("line"))


def index_blocks(postings: DataFrame, block: int = 10_000) -> DataFrame:
    """(term, block, line): the text form in blocks of doc_ids, so that no row grows with a term's documents."""
    lines = postings.select("term", F.floor(F.col("doc_id") / block).alias("block"), "doc_id", F.concat(F.lit("\t"), F.col("doc_id"), F.lit(": "), F.array_join("positions", ",")).alias("entry"))
    grouped = lines.groupBy("term", "block").agg(F.count(F.lit(1)).alias("df"), F.sort_array(F.collect_list(F.struct("doc_id", "entry"))).alias("entries"))
    return grouped.select("term", "block", F.concat_ws("\n", F.concat_ws(" ", "term", F.col("df").cast("string")), F.array_join(F.col("entries.entry"), "\n")).alias("line"))


def parsed_index(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, positions, tf) of index text; ``blocks`` has value, a term's line with its indented lines. Broken lines are left out."""
    parts = blocks.select(F.split("value", "\n").alias("l"))
    each = parts.select(F.regexp_extract(F.col("l")[0], r"^(.*) \d+$", 1).alias("term"), F.explode(F.slice("l", 2, F.size("l"))).alias("entry"))
    numbers = F.transform(F.split(F.regexp_extract("entry", r": ([\d,]*)$", 1), ","), lambda x: x.try_cast("int"))
    rows = each.select("term", F.regexp_extract("entry", r"^\t(\d+): ", 1).try_cast("long").alias("doc_id"), F.array_compact(numbers).alias("positions"))
    return rows.where("doc_id is not null and term != ''").select("term", "doc_id", "positions", F.size("positions").alias("tf"))


def numbered(rows: DataFrame, order: list[str], start: int = 0, name: str = "doc_id") -> DataFrame:
    """Contiguous numbers from ``start`` in the order of the columns, without one task that sorts everything.

    Rows are sorted by range; a partition's numbers begin where the sizes of those before it end. Only those sizes
    reach the driver. ``order`` should be unique for the numbers to be the same in every run.
    """
    spark = rows.sparkSession
    path = scratch(spark, "numbered")
    # written, so that the numbers stay what they are when a task runs again
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes = kept.groupBy("_part").count().orderBy("_part").collect()
    starts, at = [], start
    for part, n in sizes:
        starts.append((part, at))
        at += n
    offsets = spark.createDataFrame(starts or [(0, start)], "_part long, _start long")
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + place).drop("_part", "_at", "_start")


def renumbered(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """``rows`` with doc_id assigned anew."""
    return numbered(rows.drop("doc_id"), order, start)


def unprocessed(fragments: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("source", "crawl_date", "frag_index")) -> DataFrame:
    """The fragments that aren't in ``done``; null keys match null keys."""
    on = None
    right = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    return fragments.join(right, on, "left_anti")


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
