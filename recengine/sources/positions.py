"""The place of a row in its source, from Spark's file metadata.

``input_pos`` is a comparable struct that orders rows as a reader of the files, by name, would meet them; nothing is
sorted or shuffled for it.  Parquet files know the index of each row.  Text files (CSV, JSON lines, plain text) know the
split a row was read from; within a split Spark's running id follows the lines.  The names of the files Spark
writes follow the order of its partitions, so a table written in some order is read back with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INPUT_POS = "input_pos"


def parquet_pos() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def text_pos() -> Column:
    """For CSV, JSON lines and text scans (a whole-file scan such as ``multiLine`` is one split)."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("row"))


def with_input_pos(scan: DataFrame, kind: str = "parquet", name: str = INPUT_POS) -> DataFrame:
    """A file scan with its rows' positions; to be called on the scan itself, before any shuffle.  ``kind``: 'parquet' or 'text'."""
    if kind not in ("parquet", "text"):
        raise ValueError(f"kind must be 'parquet' or 'text', got {kind!r}")
    return scan.select("*", (parquet_pos() if kind == "parquet" else text_pos()).alias(name))
