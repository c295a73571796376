"""Statistics over loci, baselines and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.missing import finite, observed, statistic, to_percent
from ..functions.protocol import Window
from ..sources.cells import KEY

MAD = 1.4826


def aggregate_loci(cells: DataFrame, mode: str = "median", value: str = "x") -> DataFrame:
    """One trace y a segment: the median or mean of the observed loci at each time, NULL where none is."""
    if mode not in ("median", "mean"):
        raise ValueError(f"unknown aggregation {mode}")
    return cells.groupBy(*KEY, "vessel_type", "t_idx", "t").agg(statistic(observed(F.col(value), F.col("m")), mode).alias("y"))


def baseline_per_locus(cells: DataFrame, window: Window, stat: str = "median") -> DataFrame:
    return cells.where(window.holds(F.col("t"))).groupBy(*KEY, "locus").agg(statistic(observed(F.col("x"), F.col("m")), stat).alias("base"))


def min_valid(frac: float | None, absolute: int, loci: Column) -> Column:
    """The fewest observed loci that count as support: a share of all, rounded up, or a number."""
    if frac is None:
        return F.lit(absolute)
    if not 0 < frac <= 1:
        raise ValueError("the share must be over 0 and at most 1")
    return F.ceil(F.lit(float(frac)) * loci)


def support(cells: DataFrame, frac: float | None = None, absolute: int = 12) -> DataFrame:
    """Observed loci and whether they are enough, for each time."""
    per = cells.groupBy(*KEY, "t_idx").agg(F.sum(F.col("m").cast("int")).alias("n_valid"), F.count("*").alias("n_loci"))
    return per.withColumn("supported", F.col("n_valid") >= min_valid(frac, absolute, F.col("n_loci")))


def percent_trace(cells: DataFrame, window: Window, order: str = "aggregate_then_percent", mode: str = "median", kind: str = "delta_over_baseline") -> DataFrame:
    """Traces in percent of their baseline: of the aggregated trace, or of each locus before aggregating."""
    if order == "aggregate_then_percent":
        y = aggregate_loci(cells, mode)
        base = F.median(F.when(window.holds(F.col("t")), F.col("y"))).over(W.partitionBy(*KEY))
        return y.withColumn("y", to_percent(F.col("y"), base, kind))
    if order != "percent_then_aggregate":
        raise ValueError(order)
    base = F.median(F.when(window.holds(F.col("t")) & F.col("m"), F.col("x"))).over(W.partitionBy(*KEY, "locus"))
    return aggregate_loci(cells.withColumn("x", to_percent(F.col("x"), base, kind)), mode)


def center_and_scale(cells: DataFrame, window: Window, mode: str = "global", floor: float = 1e-6) -> DataFrame:
    """mu and sd of each locus: baseline median and scaled median deviation, pooled over loci or of each one.

    A scale of zero falls back to the deviation of the residuals, then to 1; ``floor`` is the least scale."""
    by = KEY if mode == "global" else [*KEY, "locus"]
    inside = cells.where(window.holds(F.col("t")) & F.col("m") & F.col("x").isNotNull())
    centred = inside.withColumn("mu", F.median("x").over(W.partitionBy(*KEY, "locus"))).withColumn("r", F.col("x") - F.col("mu"))
    middle = centred.withColumn("mid", F.median("r").over(W.partitionBy(*by)))
    scale = middle.groupBy(*by).agg((MAD * F.median(F.abs(F.col("r") - F.col("mid")))).alias("mad"), F.stddev_pop("r").alias("sd0"))
    sd = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd0") > 0, F.col("sd0")).otherwise(1.0)
    loci = cells.select(*KEY, "locus").distinct().join(centred.groupBy(*KEY, "locus").agg(F.first("mu").alias("mu")), [*KEY, "locus"], "left")
    return loci.join(scale, by, "left").select(*KEY, "locus", "mu", F.greatest(sd, F.lit(floor)).alias("sd"))


def locus_band(cells: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Median and two quantiles over the observed loci at each time."""
    q = F.percentile(observed(F.col("x"), F.col("m")), F.array(F.lit(low), F.lit(0.5), F.lit(high)))
    return cells.groupBy(*KEY, "t_idx").agg(q.alias("q")).select(*KEY, "t_idx", F.col("q")[0].alias("q_low"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q_high"))


def sampling_interval(traces: DataFrame) -> DataFrame:
    step = F.col("t") - F.lag("t").over(W.partitionBy(*KEY).orderBy("t_idx"))
    return traces.withColumn("d", step).groupBy(*KEY).agg(F.median("d").alias("dt"))


def group_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, quartiles, mean, deviation and number of values of each group."""
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.median(value).alias("median"), q.alias("q"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return out.select(*by, "median", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"), "mean", "sd", "n")


def summary_with_all(df: DataFrame, group: str, other: str, value: str) -> DataFrame:
    """Median and number by both columns and by ``other`` alone, where ``group`` then says all."""
    sets = df.groupingSets([[group, other], [other]], group, other)
    return sets.agg(F.median(value).alias("median"), F.median(F.abs(F.col(value))).alias("median_abs"), F.count(value).alias("n"), F.grouping(group).alias("whole")).select(F.when(F.col("whole") == 1, "all").otherwise(F.col(group)).alias(group), other, "median", "median_abs", "n")


def bland_altman(df: DataFrame, subject: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean and deviation of the differences from each subject's mean, and the limits of agreement."""
    by = by or []
    diff = df.where(F.col(value).isNotNull()).withColumn("d", F.col(value) - F.avg(value).over(W.partitionBy(*by, subject)))
    out = diff.groupBy(*by).agg(F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"), F.count("*").alias("n"), F.count_distinct(subject).alias("n_subjects"))
    return out.withColumns({"loa_low": F.col("bias") - 1.96 * F.col("sd"), "loa_high": F.col("bias") + 1.96 * F.col("sd")})


def correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson's r over the pairs in which both are there; NULL for fewer than three."""
    both = df.where(finite(F.col(x)).isNotNull() & finite(F.col(y)).isNotNull())
    return both.groupBy(*by).agg(F.corr(x, y).alias("r"), F.count("*").alias("n")).withColumn("r", F.when(F.col("n") >= 3, F.col("r")))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str]) -> DataFrame:
    """Counts in equal bins from low to high; the last holds its right edge."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def rank_distribution(ranked: DataFrame, by: list[str], rank: str, category: str, ranks: list, categories: list) -> DataFrame:
    """Count and share of every rank and category in each group, zero where none occurs."""
    grid = ranked.select(*by).distinct().withColumn(rank, F.explode(F.array(*map(F.lit, ranks)))).withColumn(category, F.explode(F.array(*map(F.lit, categories))))
    counted = ranked.groupBy(*by, rank, category).agg(F.count("*").alias("n"))
    out = grid.join(counted, [*by, rank, category], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(*by, rank))
    return out.withColumn("total", total).withColumn("fraction", F.when(F.col("total") > 0, F.col("n") / F.col("total")))


def energy_ratio(components: DataFrame, by: list[str], artefact: str = "a", signal: str = "s") -> DataFrame:
    """Frobenius norm of the artefact over that of the signal on observed cells."""
    on = components.where("m")
    return on.groupBy(*by).agg((F.sqrt(F.sum(F.col(artefact) ** 2)) / (F.sqrt(F.sum(F.col(signal) ** 2)) + 1e-8)).alias("ratio"), F.count("*").alias("n_obs"))


def colour_range(df: DataFrame, by: list[str], value: str, low: float = 0.01, high: float = 0.99, pad: float = 0.05) -> DataFrame:
    """Two outer quantiles of each group, apart by ``pad`` of their distance on both sides."""
    out = df.groupBy(*by).agg(F.percentile(F.col(value), F.array(F.lit(low), F.lit(high))).alias("q"))
    wide = pad * (F.col("q")[1] - F.col("q")[0])
    return out.select(*by, (F.col("q")[0] - wide).alias("low"), (F.col("q")[1] + wide).alias("high"))


def deviates(multiplier: Column, tolerance: float = 0.05) -> Column:
    """Whether a cycle's multiplier is further from 1 than the tolerance."""
    return F.abs(multiplier - 1) > tolerance
