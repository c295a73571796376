"""The comparisons of a study: methods within each condition and one method across conditions, for every measure, vessel and bias at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from . import ranking as R
from .aggregates import group_summary
from .sequences import holm

# What is compared, and the family whose p values are adjusted.
WITHIN = (("rpca", "sms_avg"), ("rpca", "sms"))
ACROSS = ("sms_avg", "stationary", "non_stationary")
AMPLITUDES = ("MD", "MC", "DA")
PRIMARY = {"artery": ("abs_bias_MD", "abs_bias_MC", "abs_bias_DA"), "vein": ("abs_bias_MD",)}
PRIMARY_COMPARISON = "rpca vs sms_avg (non_stationary)"
BY = ["comparison", "condition", "vessel_type", "metric"]


def measures(rows: DataFrame, keys: list[str], biomarkers: Iterable[str] = tuple(M.BIASES), cycles: Iterable[int] = (0, 1, 2)) -> DataFrame:
    """keys, metric, cycle, value of rows as ``evaluation.evaluate`` gives them: SDR, NMSE (cycle -1), bias_<biomarker>, and abs_bias_ of amplitudes.
    Columns that are not there are passed over."""
    found = [("SDR", -1, F.col("sdr")), ("NMSE", -1, F.col("nmse"))]
    for b in biomarkers:
        for c in cycles:
            if (name := f"bias_{b}_c{c}") in rows.columns:
                found.append((f"bias_{b}", c, F.col(name)))
                if b in AMPLITUDES:
                    found.append((f"abs_bias_{b}", c, F.abs(name)))
    each = [F.struct(F.lit(m).alias("metric"), F.lit(c).alias("cycle"), v.cast("double").alias("value")) for m, c, v in found]
    return rows.select(*keys, F.explode(F.array(*each)).alias("e")).select(*keys, "e.*").where("value is not null")


def differences(values: DataFrame, cluster: str, within=WITHIN, across=ACROSS) -> DataFrame:
    """comparison, condition, vessel_type, metric, cluster, d, n: each cluster's median difference, from columns condition, vessel_type, cluster,
    config, cycle, method, metric, value. Two aggregates bring the sides of every pair together; nothing is joined."""
    sample = ["vessel_type", "metric", cluster, "config", "cycle"]
    side = lambda c, what: F.avg(F.when(F.col(c) == what, F.col("value")))
    methods = sorted({m for pair in within for m in pair})
    wide = values.groupBy("condition", *sample).agg(*[side("method", m).alias(f"m_{m}") for m in methods])
    name = lambda a, b: F.concat(F.lit(f"{a} vs {b} ("), F.col("condition"), F.lit(")"))
    pairs = [F.struct(name(a, b).alias("comparison"), (F.col(f"m_{a}") - F.col(f"m_{b}")).alias("d")) for a, b in within]
    inside = wide.select("condition", *sample, F.explode(F.array(*pairs)).alias("p")).select("p.comparison", "condition", *sample, "p.d")
    method, one, two = across
    amplitude = F.regexp_extract("metric", "^(?:abs_)?bias_(.*)$", 1).isin(*AMPLITUDES)
    both = values.where((F.col("method") == method) & amplitude).groupBy(*sample).agg(side("condition", one).alias("a"), side("condition", two).alias("b"))
    absolute = F.when(F.col("metric").startswith("abs_"), " (|bias|)").otherwise("")
    cross = both.select(F.concat(F.lit(f"{method} {one.replace('_', '-')} vs {two.replace('_', '-')}"), absolute).alias("comparison"), F.lit("cross").alias("condition"), *sample, (F.col("a") - F.col("b")).alias("d"))
    rows = inside.unionByName(cross).where("d is not null")
    return rows.groupBy(*BY, cluster).agg(F.median("d").alias("d"), F.count("*").alias("n"))


def is_primary() -> Column:
    kinds = [(F.col("vessel_type") == v) & F.col("metric").isin(*ms) for v, ms in PRIMARY.items()]
    return (F.col("comparison") == PRIMARY_COMPARISON) & (kinds[0] | kinds[1])


def compared(values: DataFrame, cluster: str, resamples: int = 5000, seed: int = 0) -> DataFrame:
    """BY, n_clusters, n_samples, median, ci_low, ci_high, p, primary, p_holm: statistics over clusters of every comparison; Holm's adjustment over the
    primary family (NULL outside it)."""
    out = M.cluster_stats(differences(values, cluster), BY, resamples, seed=seed).withColumn("primary", is_primary())
    family = out.where(F.col("primary") & F.col("p").isNotNull()).withColumn("whole", F.lit(0))
    return R.same(out, holm(family, "p", ["whole"]).select(*BY, "p_holm"), BY, "left")


def amplitude_summary(values: DataFrame) -> DataFrame:
    """vessel_type, condition, method, metric, with the median, quartiles and number of signed biases of amplitudes, and of their absolute values."""
    return group_summary(values.where(F.col("metric").rlike("^(abs_)?bias_(MD|MC|DA)$")), ["vessel_type", "condition", "method", "metric"], "value")
