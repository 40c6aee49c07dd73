"""Readers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsight import schemas
from veilsight.config import TEXT_FIELDS
from veilsight.functions.text import nfkc
from veilsight.operators.sampling import bernoulli


def clauses(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Labelled clauses from JSON lines, CSV or Parquet; malformed lines and rows without clause or label are left out."""
    fmt = fmt or ("csv" if ".csv" in path else "parquet" if ".parquet" in path else "json")
    if fmt == "csv":
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    elif fmt == "json":
        rows = spark.read.schema(schemas.CLAUSES).json(path, mode="DROPMALFORMED")
    else:
        rows = spark.read.parquet(path)
    missing = {"clause", "label"} - set(rows.columns)
    if missing:
        raise ValueError(f"{path} lacks columns {sorted(missing)}")
    return rows.where("clause IS NOT NULL AND label IS NOT NULL AND trim(clause) <> ''")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines that are not blank, and those of them that are not JSON."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.agg(F.count("*").alias("lines"), F.count_if(F.get_json_object("value", "$").isNull()).alias("malformed"))


def with_places(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Clauses with clause_pos where the source has none: their place in the field by the given columns."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("uuid", "field").orderBy(*order)) - 1
    return rows.withColumn("clause_pos", at.cast("int"))


def field_place(fields: Sequence[str] = TEXT_FIELDS) -> Column:
    """A field's place in the list, for sorting a record's clauses."""
    return F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))


def records_of(rows: DataFrame, fields: Sequence[str] | None = None, share: float = 1.0, max_records: int = 0, seed: int = 42) -> DataFrame:
    """uuid and items, its clauses in order of field and place; listed fields only, a share of the records, so many at most."""
    kept = rows if fields is None else rows.where(F.col("field").isin(*fields))
    kept = bernoulli(kept, share, F.col("uuid"), seed)
    place = field_place(fields or TEXT_FIELDS)
    extra = [c for c in ("label", "matched_terms") if c in rows.columns]
    item = F.struct(place.alias("field_pos"), "clause_pos", "field", *[c for c in ("clause",) if c in rows.columns], *extra)
    out = kept.groupBy("uuid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return out.orderBy("uuid").limit(max_records) if max_records else out


def csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV of a declared schema; empty texts stay texts."""
    rows = spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True, nullValue="\x00", emptyValue="")
    return rows.select(*columns) if columns else rows


def wanted(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that are there."""
    return rows.select(*[c for c in columns if c in rows.columns])


def candidates(stats: DataFrame, min_freq: int = 1, min_effect: float = 0.0) -> DataFrame:
    """token and alpha_tier of rows over both thresholds; without an effect or tier column that test passes or the tier is null."""
    rows = stats.where(F.col("freq_profile") >= min_freq)
    rows = rows.where(F.col("effect_size") >= min_effect) if "effect_size" in stats.columns else rows
    tier = F.col("alpha_tier") if "alpha_tier" in stats.columns else F.lit(None).cast("string")
    return rows.select(F.lower(F.trim("token")).alias("token"), tier.alias("alpha_tier")).where("token <> ''").distinct()


def dictionary(rows: DataFrame, min_count: int = 1, min_odds: float = 1.0) -> DataFrame:
    """NFKC-normalised tokens over both thresholds."""
    kept = rows.where((F.col("count_PROFILE") >= min_count) & (F.col("odds_ratio") >= min_odds))
    return kept.select(nfkc("token").alias("token")).where("token <> ''").distinct()


def allowed_phrases(phrases: DataFrame, low: int = 0, high: int = 0) -> DataFrame | None:
    """phrase of a frequency in the band; None, for no limit, when both ends are open."""
    if low <= 0 and high <= 0:
        return None
    rows = phrases.where(F.col("freq") >= low) if low > 0 else phrases
    rows = rows.where(F.col("freq") <= high) if high > 0 else rows
    return rows.select("phrase").distinct()


def parse_sets(rows: DataFrame, column: str = "terms_json", count: str = "uuid_count") -> DataFrame:
    """terms (sorted) and cnt from JSON text; empty sets left out."""
    terms = F.array_sort(F.array_distinct(F.from_json(column, "array<string>")))
    return rows.select(terms.alias("terms"), F.col(count).cast("long").alias("cnt")).where(F.size("terms") > 0)


def support_index(sets: DataFrame) -> DataFrame:
    """qi, record_count and strictest tier, one row a set."""
    tier = F.array_min(F.filter("tiers", lambda t: t != "")) if "tiers" in sets.columns else F.lit(None).cast("string")
    return sets.groupBy(F.col("terms").alias("qi")).agg(F.max("record_count").alias("record_count"), F.min(tier).alias("tier"))


def sampled(rows: DataFrame, key: str, max_rows: int = 0, share: float = 1.0, seed: int = 42) -> DataFrame:
    """The share of the first max_rows rows by key: the limit counts rows looked at."""
    return bernoulli(rows.orderBy(key).limit(max_rows) if max_rows else rows, share, F.col(key), seed)


def unite(*sources: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All rows of sources that have the same columns, or the named columns of sources that have more."""
    named = list(columns or sources[0].columns)
    for s in sources:
        if columns is None and set(s.columns) != set(named) or not set(named) <= set(s.columns):
            raise ValueError(f"sources differ in columns {sorted(set(s.columns) ^ set(named))}: name those to keep")
    out = sources[0].select(*named)
    for s in sources[1:]:
        out = out.unionByName(s.select(*named))
    return out


def labelled_texts(rows: DataFrame) -> DataFrame:
    return rows.where("clause IS NOT NULL AND trim(clause) <> '' AND label IS NOT NULL").select("clause", "label")
