"""Reading the passage corpus and the book dimension, and laying the corpus out for Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import present

PASSAGES = T.StructType(
    [
        T.StructField("row_idx", T.LongType()),
        T.StructField("book_idx", T.IntegerType()),
        T.StructField("chapter", T.IntegerType()),
        T.StructField("verse", T.IntegerType()),
        T.StructField("text_en", T.StringType()),
        T.StructField("text_cn", T.StringType()),
    ]
)

BOOKS = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("en", T.StringType()),
        T.StructField("cn", T.StringType()),
        T.StructField("chapters", T.ArrayType(T.IntegerType())),
        T.StructField("enAlias", T.ArrayType(T.StringType())),
        T.StructField("cnAlias", T.ArrayType(T.StringType())),
    ]
)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, size, rec, text)``: the pieces of JSON arrays of arrays that end in ``]``, numbered in each file.

    Spark cuts the files into byte ranges and at every ``]``. Whether one ends a record or stands in
    a string depends on the quotes before it: they are summed up inside each byte range, and
    over the ranges of a file, of which there is one row each. Only the pieces of records that
    hold a bracket in a string meet again, record by record.
    """
    meta = F.col("_metadata")
    pieces = spark.read.text(path, lineSep="]").select(
        meta["file_path"].alias("file"),
        meta["file_size"].alias("size"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    here = W.partitionBy("file", "block").orderBy("id")
    pieces = pieces.withColumn("quotes", F.length(bare) - F.length(F.replace(bare, F.lit('"'))))
    pieces = pieces.withColumn("sum", F.sum("quotes").over(here.rowsBetween(W.unboundedPreceding, 0)))
    even = F.col("sum") % 2 == 0
    ranges = pieces.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.count_if(even).alias("n_even"), F.count_if(~even).alias("n_odd")
    )
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    ends = F.when(F.col("odd") == 0, F.col("n_even")).otherwise(F.col("n_odd"))
    ranges = ranges.withColumn("ends", ends).select(
        "file", "block", "odd", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first")
    )
    placed = pieces.join(ranges, ["file", "block"]).withColumns(
        {"ends": (F.col("odd") + F.col("sum")) % 2 == 0, "inside": (F.col("odd") + F.col("sum") - F.col("quotes")) % 2 == 1}
    )
    earlier = F.sum(F.col("ends").cast("long")).over(here.rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("rec", F.col("first") + F.coalesce(earlier, F.lit(0)))
    alone = F.col("ends") & ~F.col("inside")
    held = F.sort_array(F.collect_list(F.struct("block", "id", "value")))
    joined = placed.where(~alone).groupBy("file", "size", "rec").agg(held.alias("held"))
    joined = joined.select("file", "size", "rec", F.array_join(F.transform("held", lambda x: x["value"]), "]").alias("text"))
    return placed.where(alone).select("file", "size", "rec", F.col("value").alias("text")).unionByName(joined)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Read ``[[book, chapter, verse, en, cn], ...]`` JSON into the passages table.

    A large file is read by many tasks. Rows are numbered in the order of the array, files in path
    order. Convert once with ``write_passages`` and work on the result. A file that is no such
    array, or one that ends early, is an error.
    """
    records = _records(spark, path)
    first = F.col("rec") == 0
    opened = F.when(~first, F.col("text")).when(
        F.col("text").rlike(r"^\s*\["), F.regexp_replace("text", r"^\s*\[", "")
    )
    begins = F.when(first, F.col("opened").rlike(r"^\s*\[")).otherwise(F.col("opened").rlike(r"^\s*,\s*\["))
    no_array = lambda c: F.raise_error(F.concat(F.lit("malformed array of arrays: "), F.col(c)))
    records = records.withColumn("opened", F.coalesce(opened, no_array("file"))).withColumn(
        "blank", F.col("opened").rlike(r"^\s*$")
    )
    body = F.when(begins, F.concat(F.regexp_replace("opened", r"^[\s,]+", ""), F.lit("]")))
    rows = records.where("not blank").select(
        "file", "rec", F.from_json(F.coalesce(body, no_array("file")), "array<string>", {"mode": "FAILFAST"}).alias("r")
    )
    # The outer bracket closes a blank piece; what follows it, if the file goes on, is blank as well.
    files = records.groupBy("file", "size").agg(
        F.count_if(~F.col("blank")).alias("n"), F.count_if("blank").alias("blanks"), F.sum(F.octet_length("text") + 1).alias("bytes")
    )
    whole = F.col("blanks") == F.col("bytes") - F.col("size") + 1
    # One row per file, so the window sees the file list only, never the passages.
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    offsets = files.withColumn("n", F.when(whole, F.col("n")).otherwise(no_array("file").cast("long")))
    offsets = offsets.select("file", F.col("n").alias("own"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(offsets.where("own >= 0"), "file").select(
        (F.col("start") + F.col("rec")).alias("row_idx"),
        F.get("r", F.lit(0)).cast("int").alias("book_idx"),
        F.get("r", F.lit(1)).cast("int").alias("chapter"),
        F.get("r", F.lit(2)).cast("int").alias("verse"),
        present(F.get("r", F.lit(3))).alias("text_en"),
        present(F.get("r", F.lit(4))).alias("text_cn"),
    )


def write_passages(passages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write passages as Parquet clustered by address.

    Range partitioning on the whole address cuts a very large book or chapter over many
    files, and the sorted files give tight min/max statistics for address and row filters.
    """
    key = ["book_idx", "chapter", "verse", "row_idx"]
    passages.repartitionByRange(*key).sortWithinPartitions(*key).write.mode(mode).parquet(path)


def save_passages_table(
    passages: DataFrame, table: str, path: str, buckets: int, mode: str = "errorifexists"
) -> DataFrame:
    """Write passages as a table bucketed and sorted by ``row_idx`` and return it.

    Searches and views join text to rows by ``row_idx``. Over this table only the rows asked
    for are shuffled; the text stays where it is. ``row_idx`` is unique, so buckets are even.
    """
    (
        passages.repartition(buckets, "row_idx")
        .write.mode(mode)
        .bucketBy(buckets, "row_idx")
        .sortBy("row_idx")
        .option("path", path)
        .saveAsTable(table)
    )
    return passages.sparkSession.table(table)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Read the book dimension; ``book_pos`` keeps the order of the file. A broken file is an error."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.from_json("value", T.ArrayType(BOOKS), {"mode": "FAILFAST"})).alias("book_pos", "b"))
        .select("book_pos", "b.*")
    )


def address_dim(passages: DataFrame) -> DataFrame:
    """One row per address; of duplicated addresses the last row counts.

    Only the key and the row number go through the shuffle, combined map-side first, so a
    heavily duplicated address costs one row per task.
    """
    return passages.groupBy("book_idx", "chapter", "verse").agg(
        F.max("row_idx").alias("row_idx")
    )


def corpus_shape(books: DataFrame, addresses: DataFrame) -> DataFrame:
    """Verse count per chapter as declared by the dimension and as found in the corpus."""
    declared = books.select(
        F.col("idx").alias("book_idx"), F.posexplode("chapters").alias("pos", "declared")
    ).select("book_idx", (F.col("pos") + 1).alias("chapter"), "declared")
    found = (
        addresses.where("verse >= 1")
        .groupBy("book_idx", "chapter")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    return declared.join(found, ["book_idx", "chapter"], "full").select(
        "book_idx",
        "chapter",
        F.coalesce("declared", F.lit(0)).alias("declared"),
        F.coalesce("found", F.lit(0)).alias("found"),
    )
