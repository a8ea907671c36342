"""Answer records: a question, the answer given to it, and the true result of its query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caseweave.storage import keep

# The true result is kept as JSON text: it may be one number, a row or a table.
RECORD = "query_id string, query string, response string, metadata struct<execution_result: string>"


def read_answers(spark: SparkSession, path: str, lines: bool = False, split_bytes: int | None = None) -> DataFrame:
    """(query_id, query, response, execution_result).

    A file is one JSON object with its records under ``results``, or, with ``lines``, has one record per
    line. Both forms are read by many tasks; ``split_bytes`` is how much of a file each gets.
    """
    if lines:
        records = spark.read.schema(RECORD).json(path)
    else:
        text = array_records(spark, path, "results", split_bytes)
        records = text.select(F.from_json("record", RECORD).alias("r")).select("r.*")
    return records.select(
        "query_id",
        F.coalesce("query", F.lit("")).alias("query"),
        F.coalesce("response", F.lit("")).alias("response"),
        F.col("metadata.execution_result").alias("execution_result"),
    )


# --- one JSON object per file, read in parts -----------------------------------------------------------
#
# A file is read as text that is separated by closing braces, which the reader may split at any byte. What
# a piece of it means depends on what stands before: whether it begins inside a string, and how deep. Both
# are sums over the pieces before: of quotes, and then of braces outside strings. Sums go up by split and
# come down again, so no task goes through a whole file.


def _before(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """The pieces with the sum of ``value`` over all pieces before them in their file."""
    own = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    splits = pieces.groupBy("file", "split").agg(F.sum(value).alias("in_split"))
    of_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("in_split").over(of_file), F.lit(0)).alias("splits_before"))
    joined = pieces.join(splits, ["file", "split"])
    return joined.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)) + F.col("splits_before")).drop("splits_before")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


_STRING = r'"(?:[^"\\]|\\.)*"'


def array_records(spark: SparkSession, path: str, key: str, split_bytes: int | None = None) -> DataFrame:
    """(file, n, record): the objects of the array under ``key`` of the JSON object that each file holds, as text, rising by n."""
    reader = spark.read.option("lineSep", "}")
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", whole if split_bytes is None else str(split_bytes))
    try:  # a split is known by where its block begins; pieces of one are read in order
        place = [F.input_file_name().alias("file"), F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("place")]
        pieces = keep(reader.text(path).select("value", *place), "pieces")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # an escape is never cut in two: braces are not escaped
    pieces = pieces.withColumn("plain", plain).withColumn("quotes", _count(F.col("plain"), '"'))
    pieces = _before(pieces, "quotes", "quotes_before").withColumn("in_string", F.col("quotes_before") % 2 == 1)
    head = F.when(F.col("in_string"), F.regexp_replace("plain", '^[^"]*("|$)', "")).otherwise(F.col("plain"))
    pieces = pieces.withColumn("outside", F.regexp_replace(head, '"[^"]*("|$)', ""))
    # a piece is followed by a closing brace, which counts outside strings (after the last piece nothing matters)
    closes = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0).cast("long")
    opens = _count(F.col("outside"), "{")
    pieces = _before(pieces.withColumn("opens", opens).withColumn("deeper", opens - closes), "deeper", "depth")
    pieces = pieces.withColumn("inside", F.col("depth") + F.col("opens") >= 2)  # part of an object in the top one
    done = F.col("inside") & (F.col("depth") + F.col("deeper") == 1)
    pieces = _before(pieces.withColumn("done", done.cast("long")), "done", "n")
    # between objects: a string that began in an earlier piece is of no interest
    between = F.when(F.col("in_string"), F.regexp_replace("value", r'(?s)^(?:[^"\\]|\\.)*"', "")).otherwise(F.col("value"))
    pieces = pieces.withColumn("between", F.when(F.col("depth") <= 1, between))
    begin = rf'(?s)^\s*\{{?(?:[^"{{]|{_STRING})*?"{key}"\s*:\s*\[\s*(?=\{{)'
    first = pieces.filter(F.col("inside") & F.col("between").rlike(begin)).groupBy("file").agg(F.min("n").alias("first"))
    ends = pieces.filter("depth = 1").filter(F.col("outside").rlike(r"^[^{]*\]")).join(first, "file").filter("n > first")
    stop = ends.groupBy("file").agg(F.min("n").alias("stop"))
    wanted = pieces.filter("inside").join(first, "file").join(stop, "file", "left").filter("n >= first AND (stop IS NULL OR n < stop)")
    own = F.when(F.col("between").isNull(), F.col("value")).when(F.col("n") == F.col("first"), F.regexp_replace("between", begin, "")).otherwise(F.regexp_replace("between", r"^[^{]*", ""))
    pieces_of = F.array_sort(F.collect_list(F.struct("split", "place", own.alias("text"))))
    records = wanted.groupBy("file", "n").agg(F.concat_ws("}", F.transform(pieces_of, lambda p: p["text"])).alias("text"))
    return records.select("file", "n", F.concat("text", F.lit("}")).alias("record"))
