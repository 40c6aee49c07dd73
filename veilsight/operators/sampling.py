"""Splits, caps and samples.  Draws are hashes of a row's key, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilsight.functions import stats
from veilsight.operators import risk
from veilsight.operators.ranking import BIN_ROWS, quantile_bins, take_lowest
from veilsight.session import checkpoint, written


def bernoulli(df: DataFrame, share: float, key: Column, seed: int = 42) -> DataFrame:
    """About a share of the keys, with all their rows."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    return df if share == 1 else df.where(stats.draw(seed, key) <= share)


def at_most(df: DataFrame, cap: int, key: list[str], seed: int = 42) -> DataFrame:
    """cap rows chosen uniformly; all if cap is 0."""
    if cap <= 0:
        return df
    return take_lowest(df.withColumn("_u", stats.draw(seed, *[F.col(k) for k in key])), "_u", cap, tie=key).drop("_u")


def weighted(df: DataFrame, size: int, weight: str, key: list[str], seed: int = 42) -> DataFrame:
    """size rows without replacement, drawn in proportion to a weight above 0: the least -ln(u) / weight."""
    ranked = df.withColumn("_u", -F.log(stats.draw(seed, *[F.col(k) for k in key])) / F.col(weight))
    return take_lowest(ranked, "_u", size, tie=key).drop("_u")


def bin_equal(df: DataFrame, y: str, n_bins: int, key: list[str], per_bin: int = 0, seed: int = 42) -> DataFrame:
    """As many rows of each quantile bin of y: per_bin, or what the smallest bin has."""
    binned = quantile_bins(df, [F.col(y).asc(), *[F.col(k).asc() for k in key]], n_bins)
    if per_bin <= 0:
        per_bin = binned.groupBy("bin").count().agg(F.min("count")).first()[0] or 0
    return take_lowest(binned.withColumn("_u", stats.draw(seed, *[F.col(k) for k in key])), "_u", per_bin, F.col("bin"), key).drop("_u", "bin")


def none_anchors(token_stats: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Tokens that are clearly not significant and no rarer among NONE clauses, size of them at most."""
    return at_most(token_stats.where("q_value > 0.5 AND freq_none >= freq_profile").select("token", "freq_none"), size, ["token"], seed)


def rebalance(spans: DataFrame, max_support1: int = 0, max_none_empty: int = 0, train_only: bool = True, seed: int = 42) -> DataFrame:
    """Caps PROFILE spans of support 1 and NONE spans without terms, among train rows (or all); 0 is no cap."""
    inside = (F.col("split") == "train") if train_only else F.lit(True)
    stratum = F.when(inside & (F.col("provenance") == "PROFILE") & (F.col("support") == 1), "support1").when(inside & (F.col("provenance") == "NONE") & (F.col("size") == 0), "none_empty").otherwise("rest")
    spark = spans.sparkSession
    caps = spark.createDataFrame([("support1", max_support1 or None), ("none_empty", max_none_empty or None), ("rest", None)], "stratum string, cap long")
    ranked = spans.withColumn("_u", stats.draw(seed, F.col("text"))).withColumn("_stratum", stratum)
    return take_lowest(ranked, "_u", caps, F.col("_stratum"), ["text"]).drop("_u", "_stratum")


def stratified(df: DataFrame, label: str, size: int, key: list[str], seed: int = 42) -> DataFrame:
    """About size rows with the labels' shares kept, one of each label at least; all if there are no more."""
    total = df.count()
    if size >= total:
        return df
    share = F.bround(F.col("n") * F.lit(float(size)) / F.lit(float(total)), 0).cast("long")
    caps = df.groupBy(label).agg(F.count("*").alias("n")).select(label, F.greatest(F.lit(1).cast("long"), share).alias("cap"))
    ranked = df.withColumn("_u", stats.draw(seed, *[F.col(k) for k in key]))
    return take_lowest(ranked, "_u", caps, F.col(label), key).drop("_u")


def k_fold(df: DataFrame, k: int, key: list[str], label: str | None = None, seed: int = 42, out: str = "fold") -> DataFrame:
    """df with folds 0 to k - 1 by a hash of the key, each label spread evenly.

    Labels' rows are counted by hash bins, of some thousand rows each, so no label is sorted whole.
    """
    u = stats.draw(seed, *[F.col(c) for c in key])
    bins = max(256, df.count() // BIN_ROWS)
    rows = df.withColumn("_u", u).withColumn("_l", F.lit("") if label is None else F.col(label).cast("string")).withColumn("_b", F.floor(F.col("_u") * bins))
    starts = rows.groupBy("_l", "_b").agg(F.count("*").alias("n"))
    starts = starts.select(F.col("_l").alias("_l2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("n").over(Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_l", "_b").orderBy("_u", *key)) - 1
    placed = rows.withColumn("_at", within).join(starts, F.col("_l").eqNullSafe(F.col("_l2")) & (F.col("_b") == F.col("_b2")))
    return placed.withColumn(out, ((F.col("_start") + F.col("_at")) % k).cast("int")).drop("_u", "_l", "_b", "_l2", "_b2", "_start", "_at")


def holdout(df: DataFrame, share: float, key: list[str], seed: int = 42) -> DataFrame:
    """df with split: test for about a share of the keys."""
    return df.withColumn("split", F.when(stats.draw(seed, *[F.col(k) for k in key]) < share, "test").otherwise("train"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n and weight = rows / (labels * n)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("_rows"), F.count("*").alias("_labels"))
    return n.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("_rows") / (F.col("_labels") * F.col("n"))).alias("weight"))  # one row


def reid_samples(sets: DataFrame, terms: DataFrame, n: DataFrame, unit_type: str, min_records: int = 1, risk_zero: bool = False) -> DataFrame:
    """A training row a set: support, y_risk, tier_strictest and features.  sets has terms and record_count."""
    kept = sets.where(F.col("record_count") >= max(1, min_records)).select("terms", "record_count")
    tier = kept.select("terms", F.explode("terms").alias("term")).join(terms.select("term", "tier"), "term", "left").groupBy("terms").agg(F.min(F.when(F.col("tier") != "", F.col("tier"))).alias("tier"))
    out = kept.join(risk.set_features(kept, terms), "terms").join(tier, "terms", "left").crossJoin(F.broadcast(n))  # one row
    support = F.greatest(F.lit(1), F.col("record_count")).cast("long")
    return out.select(
        F.lit("NONE" if risk_zero else "PROFILE").alias("provenance"), F.lit(unit_type).alias("unit_type"), F.size("terms").alias("size"), "terms", support.alias("support"), "N",
        (F.lit(0.0) if risk_zero else stats.y_risk(support, F.col("N"))).alias("y_risk"), F.coalesce("tier", F.lit("")).alias("tier_strictest"),
        "char_len_max", "char_len_mean", "n_words_mean", "has_digit", "const_support_min", "const_support_mean",
    )


def balanced(samples: DataFrame, terms: DataFrame, mode: str = "lds", n_bins: int = 50, sigma: float = 2.0, clip: float = 10.0, max_samples: int = 0, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Samples with lds_weight and split: weighted by density, or cut to equal quantile bins; max_samples draws by weight."""
    key = ["unit_type", "_key"]
    rows = samples.withColumn("_key", F.array_join("terms", "\x1f"))
    if mode == "bin-equal":
        rows = bin_equal(rows, "y_risk", n_bins, key, max_samples // n_bins if max_samples else 0, seed).withColumn("lds_weight", F.lit(1.0))
    else:
        rows = risk.lds_weights(checkpoint(rows), "y_risk", n_bins, sigma, clip)
        if max_samples:
            rows = risk.lds_weights(checkpoint(weighted(checkpoint(rows), max_samples, "lds_weight", key, seed).drop("lds_weight")), "y_risk", n_bins, sigma, clip)
        rows = rows.withColumn("lds_weight", F.round("lds_weight", 6))
    keyed = risk.split_key(terms, rows.withColumn("qi", F.col("terms")).withColumn("text", F.lit("")))
    group = F.when(F.col("size") > 0, F.col("split_key")).otherwise("")
    return keyed.withColumn("split", stats.split_of(group, test_share, seed)).drop("qi", "text", "split_key", "_key")


def train_rows(scored: DataFrame, terms: DataFrame, max_support1: int = 0, max_none_empty: int = 0, train_only: bool = True, n_bins: int = 50, sigma: float = 2.0, clip: float = 10.0, max_samples: int = 0, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Scored spans with split, rebalanced, and lds_weight (1 for test rows)."""
    rows = risk.split_key(terms, scored)
    # each step reads the rows of the one before several times
    rows = checkpoint(rows.withColumn("split", stats.split_of(F.col("split_key"), test_share, seed)).drop("split_key"))
    rows = checkpoint(rebalance(rows, max_support1, max_none_empty, train_only, seed)) if max_support1 or max_none_empty else rows
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'").withColumn("lds_weight", F.lit(1.0))
    train = risk.lds_weights(train, "y_risk", n_bins, sigma, clip)
    if max_samples:
        chosen = checkpoint(weighted(checkpoint(train), max_samples, "lds_weight", ["text"], seed).drop("lds_weight"))
        train = risk.lds_weights(chosen, "y_risk", n_bins, sigma, clip)
    return train.withColumn("lds_weight", F.round("lds_weight", 6)).unionByName(test)


def sample_size(n: Column, sets: Column, available: Column) -> Column:
    """int(10 ln(n sets)) rows, at most those there are."""
    return F.least(F.floor(F.log(F.greatest(F.lit(1.0), n * sets)) * 10), available)


def target_rows(texts: DataFrame, seed: int = 42) -> DataFrame:
    """uuid, field and y = (max p - p) / max p for texts sampled by how often their set occurs, and as many without terms at 0.

    texts has uuid, field and terms.
    """
    texts = written(texts)
    sets = texts.groupBy("terms").agg(F.count("*").alias("n"))
    total = texts.agg(F.count("*").alias("total"))
    keyed = written(texts.join(sets, "terms").select("uuid", "field", "n", F.size("terms").alias("size"), stats.draw(seed, F.col("uuid"), F.col("field")).alias("_u")))
    # n rows of each set have the n
    by_n = checkpoint(keyed.where("size > 0").groupBy("n").agg((F.count("*") / F.col("n")).cast("long").alias("sets")))
    probs = by_n.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("total"))  # one row
    caps = probs.withColumn("cap", sample_size(F.col("n").cast("double"), F.col("sets"), F.col("n") * F.col("sets")).cast("long"))
    key = ["uuid", "field"]
    positive = take_lowest(keyed.where("size > 0"), "_u", caps.select(F.col("n").cast("string").alias("s"), "cap"), F.col("n"), key)
    top = probs.agg(F.max("p").alias("max_p"))
    positive = positive.join(probs.select("n", "p"), "n").crossJoin(F.broadcast(top)).select("uuid", "field", ((F.col("max_p") - F.col("p")) / F.col("max_p")).alias("y"))  # one row
    wanted = caps.agg(F.coalesce(F.sum("cap"), F.lit(0))).first()[0]
    negative = take_lowest(keyed.where("size = 0"), "_u", int(wanted), tie=key).select("uuid", "field", F.lit(0.0).alias("y"))
    return positive.unionByName(negative)


def needed_for_share(share: float, rows: int) -> int:
    """Rows to add to so many for them to be a share (0.9 at most) of all."""
    return round(min(0.9, share) / (1 - min(0.9, share)) * rows) if share > 0 else 0

