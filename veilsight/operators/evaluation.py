"""Evaluation of scores and labels, overall and by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsight.operators.ranking import average_ranks


def close(x: Column, y: Column) -> Column:
    """Within 1e-8 and a hundred-thousandth of y."""
    return F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)


def correlation(x: str, y: str) -> Column:
    """Pearson's; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def numeric_pairs(df: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose x and y are both numbers, as doubles, and one row with n and skipped."""
    a, b = df[x].cast("string").try_cast("double"), df[y].cast("string").try_cast("double")
    rows = df.select(a.alias("x"), b.alias("y"))
    good = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    return rows.where(good), rows.agg(F.count_if(good).alias("n"), F.count_if(~F.coalesce(good, F.lit(False))).alias("skipped"))


def errors(df: DataFrame) -> DataFrame:
    """mae, rmse, mse, pearson (0 where a side is constant) and n of y_pred against y_true."""
    d = F.col("y_true") - F.col("y_pred")
    return df.agg(
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d * d).alias("mse"),
        F.coalesce(correlation("y_true", "y_pred"), F.lit(0.0)).alias("pearson"), F.count("*").alias("n"),
    )


def spearman(df: DataFrame, x: str = "y_true", y: str = "y_pred") -> DataFrame:
    """Correlation of average ranks; null where a side is constant."""
    ranked = average_ranks(average_ranks(df.select(x, y), x, "rx"), y, "ry")
    return ranked.agg(correlation("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Mann-Whitney area with ties at their average rank; null without rows of both kinds."""
    ranked = average_ranks(df.select(F.col(score).alias("s"), positive.cast("int").alias("pos")), "s", "r")
    p, n = F.sum("pos"), F.count("*")
    return ranked.agg(F.when((p > 0) & (p < n), (F.sum(F.col("r") * F.col("pos")) - p * (p + 1) / 2) / (p * (n - p))).alias("auc"), p.alias("n_pos"), (n - p).alias("n_neg"))


def with_strata(df: DataFrame) -> DataFrame:
    """df with a row for each stratum of y_true it is in: 0, whole steps below the maximum, the maximum.

    A y that is close to 0 or the maximum without being it is in two.
    """
    top = df.agg(F.max("y_true").alias("ymax"))
    y, ymax = F.col("y_true"), F.col("ymax")
    lo = F.floor(y)
    step = F.when((y > 0) & (y < 1), F.lit("(0,1)")).when(
        (y >= 1) & (y < ymax), F.when(lo + 1 >= ymax, F.format_string("[%d,%.2f)", lo, ymax)).otherwise(F.format_string("[%d,%d)", lo, lo + 1))
    )
    strata = F.array_compact(F.array(F.when(close(y, F.lit(0.0)), F.lit("NONE(y=0)")), step, F.when(close(y, ymax), F.format_string("UNIQUE(y=%.2f)", ymax))))
    return df.crossJoin(F.broadcast(top)).select("*", F.explode(strata).alias("stratum"))  # one row


def stratified_errors(df: DataFrame) -> DataFrame:
    """stratum, n, mae, rmse, mean_true, mean_pred."""
    d = F.col("y_true") - F.col("y_pred")
    return with_strata(df).groupBy("stratum").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg("y_true").alias("mean_true"), F.avg("y_pred").alias("mean_pred"))


def macro_errors(df: DataFrame) -> DataFrame:
    """Means of the strata's errors, and their number."""
    return stratified_errors(df).agg(F.avg("mae").alias("macro_mae"), F.avg("rmse").alias("macro_rmse"), F.count("*").alias("strata"))


def test_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "test") if "split" in df.columns else df


def baselines(df: DataFrame, n: float | None = None) -> DataFrame:
    """y_true with y_pred of each baseline: the mean, the maximum and, where there is a support, log10(n / support).

    n is the number of records, 10 to the largest y_true unless given.
    """
    facts = df.agg(F.avg("y_true").alias("_mean"), F.max("y_true").alias("_max"))
    rows = df.crossJoin(F.broadcast(facts))  # one row
    named = {"mean": F.col("_mean"), "ymax": F.col("_max")}
    if "support" in df.columns:
        records = F.lit(float(n)) if n else F.pow(F.lit(10.0), F.col("_max"))
        named["support"] = F.when(close(F.col("y_true"), F.lit(0.0)), 0.0).otherwise(F.log10(records / F.greatest(F.lit(1.0), F.col("support").cast("double"))))
    made = F.array(*[F.struct(F.lit(k).alias("baseline"), v.alias("y_pred")) for k, v in named.items()])
    return rows.select("y_true", F.explode(made).alias("b")).select("b.baseline", "y_true", "b.y_pred")


def report(df: DataFrame, n: float | None = None) -> DataFrame:
    """A row for the model and each baseline: mae, rmse, n, macro_mae, macro_rmse, spearman, auc of reaching the maximum."""
    rows = test_rows(df)
    every = [("model", rows.select("y_true", "y_pred"))]
    made = baselines(rows, n)
    every += [(b, made.where(F.col("baseline") == b).select("y_true", "y_pred")) for b in ("mean", "ymax", *(["support"] if "support" in df.columns else []))]
    out = None
    for name, one in every:
        top = one.crossJoin(F.broadcast(one.agg(F.max("y_true").alias("ymax"))))  # one row
        line = errors(one).select(F.lit(name).alias("model"), "mae", "rmse", "n").crossJoin(macro_errors(one)).crossJoin(spearman(one).select("spearman"))
        line = line.crossJoin(auc(top, "y_pred", close(F.col("y_true"), F.col("ymax"))).select("auc"))  # one row each
        out = line if out is None else out.unionByName(line)
    return out


def confusion(df: DataFrame, labels: tuple[str, ...], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """true_label, pred_label and n for every two labels, zeros included."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "true_label string, pred_label string")
    n = df.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("n"))
    return grid.join(n, ["true_label", "pred_label"], "left").select("true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n"))


def f1_report(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """label, precision, recall, f1, support; rows for the labels and for accuracy, macro and weighted means."""
    pairs = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("t").alias("label"), F.lit(0).alias("side")), F.struct(F.col("p").alias("label"), F.lit(1).alias("side")))
    per = pairs.select("t", "p", "n", F.explode(sides).alias("s")).groupBy("s.label").agg(
        F.sum(F.when((F.col("t") == F.col("p")) & (F.col("s.side") == 0), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.side") == 1, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("s.side") == 0, F.col("n")).otherwise(0)).alias("support"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    per = per.select("label", "tp", "support", ratio("tp", "predicted").alias("precision"), ratio("tp", "support").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    per = per.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    n = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / n).alias(c)
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support"))
    mean = per.agg(F.lit("weighted avg").alias("label"), weighted("precision"), weighted("recall"), weighted("f1"), n.alias("support"))
    right = F.sum("tp") / n
    accuracy = per.agg(F.lit("accuracy").alias("label"), right.alias("precision"), right.alias("recall"), right.alias("f1"), n.alias("support"))
    return per.select("label", "precision", "recall", "f1", "support").unionByName(macro).unionByName(mean).unionByName(accuracy)


def fold_means(df: DataFrame, by: str, metric: str) -> DataFrame:
    """Mean and population deviation of a metric over folds."""
    return df.groupBy(by).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_pop(metric), F.lit(0.0)).alias("std"), F.count("*").alias("folds"))
