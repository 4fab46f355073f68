"""Raw transaction files to one typed frame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.schemas import RAW_TXN

_STRAY_INDEX = ("Unnamed: 0", "_c0")

# Texts that stand for a missing value in transaction files.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def scan_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Transaction file(s) with a header, typed by column name without reading the data twice.

    ``ord`` is the place of the row in the files. A leading index column without a name is dropped.
    The header of one file sets the order of the columns; a file with another header raises when it
    is read. Records may hold line breaks inside quotes if ``multi_line`` is set; each file is then
    read by one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    header = reader.csv(path).columns
    missing = set(RAW_TXN) - set(header)
    if missing:
        raise ValueError(f"columns missing in {path}: {sorted(missing)}")
    # In the file the index column has no name, and names are compared with those in the file.
    as_text = T.StructType([T.StructField("" if c in _STRAY_INDEX[1:] else c, T.StringType()) for c in header])
    raw = reader.schema(as_text).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    raw = raw.select("*", "_metadata")
    raw = raw.toDF(*header, "_metadata")
    # A value that is neither missing nor of its type raises.
    typed = {c: F.when(~F.col(c).isin(*MISSING), F.col(c)).cast(t) for c, t in RAW_TXN.items()}
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # Rises with the rows of a block, which one task reads from start to end.
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.withColumns({**typed, "ord": place}).drop(*_STRAY_INDEX, "_metadata")


def normalize(raw: DataFrame, keep_raw_ids: bool = False) -> DataFrame:
    """Parse times and turn numeric identifiers into text; a value that does not parse raises.

    Identifiers go through an integer, so leading zeros vanish, unless ``keep_raw_ids`` is set.
    """
    ids = {} if keep_raw_ids else {c: F.col(c).cast("bigint").cast("string") for c in ("cc_num", "zip")}
    return raw.withColumns(
        {
            **ids,
            "trans_date_trans_time": F.col("trans_date_trans_time").cast("timestamp_ntz"),
            "dob": F.col("dob").cast("date"),
        }
    ).withColumnRenamed("trans_date_trans_time", "trans_ts")


def union_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the splits in the given order; ``ord`` then orders by split first."""
    out = None
    for number, (name, df) in enumerate(splits.items()):
        part = df.withColumns(
            {"split": F.lit(name), "ord": F.struct(F.lit(number).alias("split_no"), F.col("ord").alias("place"))}
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no split given")
    return out


def read_transactions(
    spark: SparkSession, paths: Mapping[str, str], keep_raw_ids: bool = False, multi_line: bool = False
) -> DataFrame:
    """``{"train": path, "test": path}`` to one typed frame with ``split`` and ``ord``."""
    return union_splits(
        {name: normalize(scan_csv(spark, path, multi_line), keep_raw_ids) for name, path in paths.items()}
    )
