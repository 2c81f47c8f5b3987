"""Aligned pairs, their splits, and predictions kept next to them.

Tables carry an explicit key; files without one get the true position of their rows (:func:`with_positions`), so that
two of them can be aligned. Missing cells stay NULL and are counted by the scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clearlines import fixed
from clearlines.functions.prompts import pad_tokens, token_parts, training_text
from clearlines.operators.scores import align

PAIR_SCHEMA = StructType([StructField("Normal", StringType()), StructField("Simple", StringType())])


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType = PAIR_SCHEMA,
             multi_line: bool = True) -> DataFrame:
    """CSV with a header and quoted cells, under a fixed schema.

    Cells with line breaks make a file unsplittable: keep such corpora in many files, or
    say ``multi_line=False`` for corpora without them.
    """
    return (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("enforceSchema", False)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that :func:`read_csv` gives back unchanged: all cells quoted, spaces kept. Compressed if the path ends in ``.gz``."""
    packed = "gzip" if path.rstrip("/").endswith(".gz") else "none"
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("compression", packed)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_pairs(spark: SparkSession, path: str | list[str], key: str | None = None, multi_line: bool = True) -> DataFrame:
    """(pair_id, normal, simple) from CSV, or from a parquet folder (path ending in ``.parquet``).

    Without a key column ``pair_id`` is the row's position, from 0: files by path, rows as they stand. It does
    not depend on how Spark splits the files.
    """
    if isinstance(path, str) and path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        extra = [] if key is None else [StructField(key, StringType())]
        df = read_csv(spark, path, StructType(extra + PAIR_SCHEMA.fields), multi_line)
    numbered = with_positions(df, "pair_id") if key is None else df.withColumn("pair_id", F.col(key).cast("bigint"))
    return numbered.select("pair_id", F.col("Normal").cast("string").alias("normal"),
                     F.col("Simple").cast("string").alias("simple"))


def with_positions(df: DataFrame, into: str = "position") -> DataFrame:
    """Add the position of each row of a table just read from files: files in the order of their paths.

    Each part of a file (as much of it as one task reads at a time) has its rows counted, running sums over the parts give
    its first position, and a row's place in its part is added. ``df`` must be a plain read, without filters, joins or unions:
    the two passes number the rows of a part alike because they plan the same scan.
    """
    part = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")]
    placed = df.select(*df.columns, *part, F.monotonically_increasing_id().alias("_at"))
    parts = placed.groupBy("_file", "_from").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    # one row for each part of a file
    before = Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    # sent to the rows: no row moves to learn its position
    joined = placed.join(F.broadcast(parts.select("_file", "_from", base.alias("_base"))), ["_file", "_from"])
    return joined.select(*df.columns, (F.col("_at") + F.col("_base")).alias(into))


def read_aligned(spark: SparkSession, pairs: str, predictions: str, system: str = "system", multi_line: bool = True) -> DataFrame:
    """(pair_id, normal, simple, predicted, system): two CSV folders without keys, row by row.

    ``predictions`` has one column, ``Predicted``. A row more on one side is an error: nothing could then be aligned for sure.
    """
    base = read_pairs(spark, pairs, multi_line=multi_line)
    schema = StructType([StructField("Predicted", StringType())])
    told = with_positions(read_csv(spark, predictions, schema, multi_line), "_at").withColumnRenamed("Predicted", "predicted")
    both = base.join(told, F.col("pair_id") == F.col("_at"), "full_outer")
    lone = F.raise_error(F.lit("the files have different numbers of rows"))
    known = F.when(F.col("pair_id").isNull() | F.col("_at").isNull(), lone.cast("bigint")).otherwise(F.col("pair_id"))
    return both.select(known.alias("pair_id"), "normal", "simple", "predicted", F.lit(system).alias("system"))


def read_splits(spark: SparkSession, paths: dict[str, str], key: str | None = None) -> DataFrame:
    """Named files as one table with a ``split`` column."""
    return reduce(DataFrame.unionByName, [read_pairs(spark, p, key).withColumn("split", F.lit(s)) for s, p in paths.items()])


def missing_counts(pairs: DataFrame) -> DataFrame:
    """How many texts are missing, per column."""
    return pairs.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in pairs.columns if c != "pair_id"])


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest (unique) keys.

    Only keys are ranked. The rows themselves are filtered by the n-th key, so no text
    passes through a single task and the filter reaches the scan.
    """
    last = df.select(key).orderBy(key).limit(n).agg(F.max(key).alias("last"))
    return df.where(F.col(key) <= last.scalar())


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write parquet, partitioned if asked."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_predictions(pairs: DataFrame, predictions: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Predictions next to their sources, matched by key."""
    joined = align(pairs, predictions).withColumnsRenamed(
        {"normal": "Normal", "simple": "Simple", "predicted": "Predicted"})
    if fmt == "parquet":
        joined.write.mode("overwrite").parquet(path)
    else:
        write_csv(joined, path)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(pair_id, normal, simple, predicted[, system]) as written above."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
        df = read_csv(spark, path, StructType([StructField(c, StringType()) for c in header]))
        df = df.withColumn("pair_id", F.col("pair_id").cast("bigint"))
    return df.withColumnsRenamed({"Normal": "normal", "Simple": "simple", "Predicted": "predicted"})


def write_report(rows: DataFrame, path: str, run: str = "default") -> None:
    """Write (system, metric, value) rows as one run of a report table; a run of that name gives way, others stay.

    So a job that is repeated counts once. Columns: those of ``rows``, and ``run``.
    """
    (rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))


def training_tokens(pairs: DataFrame, tokenizer, pad, size: int = fixed.TRAINING_TOKENS, side: str = "left") -> DataFrame:
    """Padded token arrays of the training texts; the text columns are dropped.

    A text of more than ``size`` tokens goes on in further rows (``part`` 0, 1, ...): none is lost.
    ``tokenizer`` maps a text column to an array column (an Arrow UDF, say), ``pad`` is the padding value.
    """
    texts = pairs.withColumn("text", training_text(F.col("normal"), F.col("simple"))).drop("normal", "simple")
    # a column first: inside the parts' function the text would be cut into tokens again for each part
    cut = texts.withColumn("text", tokenizer(F.col("text")))
    others = [c for c in texts.columns if c != "text"]
    tokens = cut.select(*others, F.posexplode(token_parts(F.col("text"), size)).alias("part", "tokens"))
    return tokens.withColumn("tokens", pad_tokens(F.col("tokens"), F.lit(pad), size, side))
