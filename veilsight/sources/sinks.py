"""Writers.  Arrays become JSON text only here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsight import schemas
from veilsight.functions.text import json_key


def flat(df: DataFrame) -> DataFrame:
    """Array columns as JSON text named NAME_json."""
    return df.select(*[json_key(F.col(c)).alias(f"{c}_json") if kind == "array<string>" else F.col(c) for c, kind in df.dtypes])


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def parquet(df: DataFrame, path: str, compression: str = "zstd", by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    if compression not in ("zstd", "snappy", "gzip", "none"):
        raise ValueError(f"compression {compression}")
    writer = df.write.mode(mode).option("compression", "uncompressed" if compression == "none" else compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def typed(df: DataFrame, schema: str = schemas.RISK_SAMPLES) -> DataFrame:
    """Columns of a schema cast to its types; others as text."""
    kinds = dict(x.strip().split(" ", 1) for x in schema.split(", "))
    return df.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in df.columns])


def csv_to_parquet(spark, source: str, path: str, compression: str = "zstd") -> None:
    """A CSV of risk samples as typed Parquet, one pass, any size."""
    rows = spark.read.csv(source, header=True, escape='"', multiLine=True, nullValue="\x00", emptyValue="")
    parquet(typed(rows), path, compression)


def ordered_sets(df: DataFrame, count: str = "cnt") -> DataFrame:
    return df.orderBy(F.desc(count), json_key(F.col("terms")))


#: Fixed: the columns of a risk sample, in order.
SAMPLE_COLUMNS = (
    "provenance", "text", "qi_json", "size", "support", "N", "y_risk", "y_bits", "y_bits_capped", "min_constituent_df", "y_combined", "lds_weight", "split", "tier_strictest", "freq",
)


def samples(df: DataFrame) -> DataFrame:
    return df.select(*SAMPLE_COLUMNS)
