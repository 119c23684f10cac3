"""File sources and sinks.

Always an explicit schema (no inference).  Writers are plain
``DataFrame.write`` calls; every output goes to a caller-given folder
(on a cluster: a shared one, e.g. under ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.sources.json_arrays import read_json_array, write_json_array  # noqa: F401  (A2)
from recengine.sources.positions import with_input_pos


# A1 -- JSON lines
def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# A3/A5/A6/A7 -- delimited text
def write_delimited(df: DataFrame, path: str, sep: str, header: bool = False, encoding: str = "UTF-8",
                    mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("sep", sep).option("header", header)
     .option("encoding", encoding).csv(path))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str,
                   header: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Positional column names come from ``schema``; ``sep`` may be several
    characters (``'::'``); ``encoding`` e.g. ``'ISO-8859-1'``."""
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
            .option("encoding", encoding).option("mode", "FAILFAST").csv(path))


# A4 -- whitespace-separated relation
def write_whitespace(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]).alias("value")) \
      .write.mode(mode).text(path)


def read_whitespace(spark: SparkSession, path: str, names: list[str], types: list[str] | None = None,
                    pos: str | None = None) -> DataFrame:
    """``pos`` names a column for each line's input position."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    types = types or ["string"] * len(names)
    lines = spark.read.text(path)
    if pos:
        lines = with_input_pos(lines, "text", pos)
    return lines.filter(F.trim("value") != "").select(
        *[parts[i].cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types))], *([pos] if pos else []))


# A8/A10 -- Parquet
def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


# A9 -- labelled samples, materialised once
def materialise_samples(df: DataFrame, path: str, overwrite: bool = False, splits: Sequence[str] = ()) -> DataFrame:
    """Write labelled samples partitioned by ``split`` unless they exist
    (explicit ``overwrite`` flag instead of the reference's cache check on
    a file name), then read them back.  Rows of the named ``splits`` (letters,
    digits, _) go to their folders as they come; a write of several splits at
    once first sorts all rows of a task.  Rows of other splits are written, too."""
    from pyspark.errors import AnalysisException
    spark = df.sparkSession
    if not overwrite:
        try:
            return spark.read.schema(df.schema).parquet(path)
        except AnalysisException:      # not written yet
            pass
    if not all(re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII) for name in splits):
        raise ValueError(f"splits must be plain names, are {list(splits)!r}")
    others = df.where(F.col("split").isNull() | ~F.col("split").isin(list(splits))) if splits else df
    others.write.mode("overwrite").partitionBy("split").parquet(path)
    for name in splits:
        df.where(F.col("split") == name).drop("split").write.mode("overwrite").parquet(f"{path}/split={name}")
    return spark.read.parquet(path)
