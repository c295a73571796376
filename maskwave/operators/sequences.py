"""Operators on ordered samples: runs, running statistics, gaps, interpolation, cycles, ranks.

Every function works on ``by`` partitions ordered by t_idx, so a segment never meets another and a join on the same keys needs
no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.missing import finite, to_percent
from ..functions.protocol import Cycle, Protocol
from . import sliding


def _order(by: list[str]):
    return W.partitionBy(*by).orderBy("t_idx")


def runs(df: DataFrame, flag: Column, by: list[str]) -> DataFrame:
    """Contiguous runs of rows with the flag: start, end (inclusive) and length."""
    on = df.withColumn("on", flag).where("on")
    island = F.col("t_idx") - F.row_number().over(_order(by))
    return on.withColumn("island", island).groupBy(*by, "island").agg(F.min("t_idx").alias("start"), F.max("t_idx").alias("end"), F.count("*").cast("int").alias("length")).drop("island")


def longest_run(df: DataFrame, flag: Column, by: list[str]) -> DataFrame:
    """The longest run, the first of equals."""
    return runs(df, flag, by).groupBy(*by).agg(F.max_by(F.struct("start", "end", "length"), F.struct("length", -F.col("start"))).alias("r")).select(*by, "r.*")


def running_median(df: DataFrame, by: list[str], first: int, last: int, value: str = "y") -> Column:
    """Median of the values from row ``first`` to row ``last`` around each, short at the ends."""
    return F.percentile(F.col(value), F.lit(0.5)).over(_order(by).rowsBetween(first, last))


#: Frames of more rows than this are served by a sorted window (``sliding``) instead of being sorted anew for every row.
LONG = 31


def _medians(df: DataFrame, by: list[str], first: int, last: int, value: str) -> DataFrame:
    if last - first >= LONG:
        return sliding.by_series(df, by, value, lambda y: sliding.frames(y, first, last)[0])
    return df.withColumn(value, running_median(df, by, first, last, value))


def kotliar_median(df: DataFrame, by: list[str], fs: float, seconds: float = 4.0, value: str = "y") -> DataFrame:
    """Running median over w samples that begins half a window after each; the last half window has none."""
    w = max(1, round(seconds * fs))
    if w <= 1:
        return df
    h = w // 2
    left = F.count(F.lit(1)).over(W.partitionBy(*by)) - F.row_number().over(_order(by))
    return _medians(df, by, h, h + w - 1, value).withColumn(value, F.when(left >= h, F.col(value)))


def centred_median(df: DataFrame, by: list[str], w: int, value: str = "y") -> DataFrame:
    """Running median over 2 * (w // 2) + 1 samples."""
    return _medians(df, by, -(w // 2), w // 2, value)


def causal_median(df: DataFrame, by: list[str], w: int, value: str = "y") -> DataFrame:
    return _medians(df, by, -(w - 1), 0, value)


def padded_median(df: DataFrame, by: list[str], w: int, value: str = "y") -> DataFrame:
    """Centred running median with the end values repeated beyond the ends; w must be odd."""
    if w % 2 == 0:
        raise ValueError("the window must be odd")
    if w > LONG:
        return sliding.by_series(df, by, value, lambda y: sliding.padded(y, w))
    h = w // 2
    order, whole = _order(by), W.partitionBy(*by).orderBy("t_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    got = F.collect_list(F.struct(F.col(value).alias("v"))).over(order.rowsBetween(-h, h))
    k, n = F.row_number().over(order), F.count(F.lit(1)).over(W.partitionBy(*by))
    edge = lambda c, times: F.array_repeat(F.struct(c.alias("v")), F.greatest(times, F.lit(0)).cast("int"))
    padded = F.concat(edge(F.first(value).over(whole), h + 1 - k), got, edge(F.last(value).over(whole), k + h - n))
    return df.withColumn("w", padded).withColumn(value, array_median(F.filter(F.transform("w", lambda s: s["v"]), lambda v: v.isNotNull()))).drop("w")


def moving_mean(df: DataFrame, by: list[str], w: int, value: str = "y") -> DataFrame:
    """Mean over a centred frame, short at the ends; NULL wherever the frame holds a NULL."""
    frame = _order(by).rowsBetween(-(w // 2), w // 2)
    full = F.count(F.lit(1)).over(frame) == F.count(value).over(frame)
    return df.withColumn(value, F.when(full, F.avg(value).over(frame)))


def array_median(a: Column) -> Column:
    """Median of an array of values that are there."""
    s, n = F.array_sort(a), F.size(a)
    mid = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2
    return F.when(n > 0, mid)


def hampel(df: DataFrame, by: list[str], k: int = 5, n_sigmas: float = 3.0, value: str = "y", to_null: bool = False) -> DataFrame:
    """Replaces values further than ``n_sigmas`` scaled median deviations from the median of their frame, judged on the input."""
    if 2 * k + 1 > LONG:
        kept = df.withColumns({"outlier": F.lit(False), "w": F.col(value)})
        found = sliding.by_series(kept, by, value, lambda y: sliding.hampel(y, k, n_sigmas)[0])
        odd = F.col("w").isNotNull() & ~F.col(value).eqNullSafe(F.col("w"))
        return found.withColumn("outlier", odd).withColumn(value, F.when(F.col("outlier") & F.lit(to_null), F.lit(None).cast("double")).otherwise(F.col(value))).drop("w")
    frame = F.collect_list(value).over(_order(by).rowsBetween(-k, k))
    out = df.withColumn("w", frame).withColumn("med", array_median(F.col("w")))
    out = out.withColumn("sigma", 1.4826 * array_median(F.transform("w", lambda v: F.abs(v - F.col("med")))))
    odd = F.col(value).isNotNull() & (F.size("w") >= 3) & (F.col("sigma") > 0) & (F.abs(F.col(value) - F.col("med")) > n_sigmas * F.col("sigma"))
    out = out.withColumn("outlier", F.coalesce(odd, F.lit(False)))
    return out.withColumn(value, F.when(F.col("outlier"), F.lit(None).cast("double") if to_null else F.col("med")).otherwise(F.col(value))).drop("w", "med", "sigma")


def interpolate(df: DataFrame, by: list[str], value: str = "y", ends: str = "hold", least: int = 2, max_gap: int | None = None) -> DataFrame:
    """Straight lines over gaps by t. ``ends``: hold the outer values, or leave NULL. Fewer than ``least`` values: unchanged.

    ``max_gap``: only gaps of at most so many rows with values on both sides."""
    order = _order(by)
    past, ahead = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("t").alias("t"), F.col(value).alias("v"), F.col("t_idx").alias("i")))
    out = df.withColumn("p", F.last(here, ignorenulls=True).over(past)).withColumn("q", F.first(here, ignorenulls=True).over(ahead)).withColumn("n", F.count(value).over(W.partitionBy(*by)))
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / (F.col("q.t") - F.col("p.t"))
    inner = F.when(F.col("p").isNotNull() & F.col("q").isNotNull() & (F.lit(True) if max_gap is None else F.col("q.i") - F.col("p.i") - 1 <= max_gap), line)
    outer = F.coalesce("p.v", "q.v") if ends == "hold" and max_gap is None else F.lit(None).cast("double")
    outer = F.when(F.col("p").isNull() | F.col("q").isNull(), outer)
    return out.withColumn(value, F.when(F.col(value).isNotNull() | (F.col("n") < least), F.col(value)).otherwise(F.coalesce(inner, outer))).drop("p", "q", "n")


def resample(df: DataFrame, grid: DataFrame, by: list[str], value: str = "y") -> DataFrame:
    """Values at the grid's times (columns of ``by`` and t), by straight lines; NULL outside the span of the values."""
    both = df.where(F.col(value).isNotNull()).select(*by, "t", value, F.lit(False).alias("wanted")).unionByName(grid.select(*by, "t", F.lit(None).cast("double").alias(value), F.lit(True).alias("wanted")))
    order = W.partitionBy(*by).orderBy("t", F.col("wanted").cast("int"))
    here = F.when(~F.col("wanted"), F.struct(F.col("t").alias("t"), F.col(value).alias("v")))
    back = W.partitionBy(*by).orderBy(F.col("t").desc(), F.col("wanted").cast("int"))
    out = both.withColumn("p", F.last(here, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("q", F.last(here, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)))
    line = F.when(F.col("p.t") == F.col("q.t"), F.col("p.v")).otherwise(F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / (F.col("q.t") - F.col("p.t")))
    return out.where("wanted").select(*by, "t", F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), line).alias(value))


def stack_cycles(df: DataFrame, protocol: Protocol, by: list[str]) -> DataFrame:
    """Rows inside cycles (baseline start, or 30 s before flicker, to recovery end) with cycle_index and offset in samples."""
    spans = [(c.index, c.baseline.start if c.baseline else c.flicker.start - 30, c.recovery.end) for c in protocol.cycles]
    inside = F.array(*[F.when((F.col("t") >= a) & (F.col("t") < b), F.lit(k)) for k, a, b in spans])
    out = df.withColumn("cycle_index", F.explode(F.filter(inside, lambda k: k.isNotNull())))
    return out.withColumn("offset", F.row_number().over(W.partitionBy(*by, "cycle_index").orderBy("t_idx")) - 1)


def cycle_template(stacked: DataFrame, by: list[str], value: str = "y") -> DataFrame:
    """Median over cycles at each offset, cut to the shortest cycle."""
    length = stacked.groupBy(*by, "cycle_index").agg(F.count("*").alias("n")).groupBy(*by).agg(F.min("n").alias("n"))
    return stacked.join(length, by).where(F.col("offset") < F.col("n")).groupBy(*by, "offset").agg(F.median(value).alias("y"))


def tile(template: DataFrame, stacked: DataFrame, df: DataFrame, by: list[str], value: str = "y") -> DataFrame:
    """The template at each cycle's place in df, NULL elsewhere."""
    placed = stacked.select(*by, "t_idx", "offset").join(template.select(*by, "offset", F.col("y").alias("tiled")), [*by, "offset"], "left")
    return df.drop(value).join(placed.select(*by, "t_idx", F.col("tiled").alias(value)), [*by, "t_idx"], "left")


def cut_cycle(df: DataFrame, cycle: Cycle, by: list[str], before: float = 10.0, after: float = 70.0) -> DataFrame:
    """Samples around the onset with t_rel, less the median before it; segments without a baseline or three values are left out."""
    on = cycle.flicker.start
    cut = df.where((F.col("t") >= on - before) & (F.col("t") < on + after)).withColumn("t_rel", F.col("t") - on)
    whole = W.partitionBy(*by)
    cut = cut.withColumn("base", F.median(F.when(F.col("t_rel") < 0, F.col("y"))).over(whole)).withColumn("n", F.count("y").over(whole))
    cut = cut.where("base is not null and n >= 3").withColumn("y", F.col("y") - F.col("base"))
    return cut.drop("base", "n").withColumn("cycle_index", F.lit(cycle.index))


def overlay(cut: DataFrame, by: list[str]) -> DataFrame:
    """Mean and standard error over a population at each relative time."""
    out = cut.groupBy(*by, "t_rel").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.count("*").alias("n"))
    return out.withColumn("sem", F.col("sd") / F.sqrt("n")).drop("sd")


def rank_cycles(table: DataFrame, by: list[str], value: str) -> DataFrame:
    """highest, middle and lowest cycle of each segment by value; extra beyond three."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), "cycle_index"))
    return table.withColumn("rank", F.element_at(F.array(*map(F.lit, ("highest", "middle", "lowest", "extra"))), F.least(k, F.lit(4))))


def traces_of_ranked(ranked: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """The cut traces of ranked cycles, with their rank: an equi-join on segment and cycle."""
    return cuts.join(ranked.select(*by, "cycle_index", "rank"), [*by, "cycle_index"])


def autocorrelation(df: DataFrame, by: list[str], value: str = "y") -> DataFrame:
    """Lag-1 autocorrelation of the values that are there, in their order."""
    there = df.where(F.col(value).isNotNull()).withColumn("c", F.col(value) - F.avg(value).over(W.partitionBy(*by)))
    there = there.withColumn("l", F.lag("c").over(_order(by)))
    out = there.groupBy(*by).agg(F.avg(F.col("c") * F.col("l")).alias("a"), F.avg(F.col("c") * F.col("c")).alias("b"))
    return out.select(*by, finite(F.when(F.col("b") > 0, F.col("a") / F.col("b"))).alias("ac1"))


def shift(df: DataFrame, by: list[str], steps: int) -> DataFrame:
    """A circular shift by so many samples."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    return df.withColumn("t_idx", F.pmod(F.col("t_idx") + steps, n).cast("int"))


def dark_frames(df: DataFrame, protocol: Protocol, by: list[str], rate: float = 12.5) -> Column:
    """True for frames that stay: outside flicker all, inside every k-th."""
    k = max(1, round(protocol.fs / rate))
    keep = F.lit(True)
    for w in protocol.phase("flicker"):
        first = F.min(F.when(w.holds(F.col("t")), F.col("t_idx"))).over(W.partitionBy(*by))
        keep = F.when(w.holds(F.col("t")), F.pmod(F.col("t_idx") - first, F.lit(k)) == 0).otherwise(keep)
    return keep


def holm(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Step-down adjusted p: the running largest of (m - rank) * p, at most 1."""
    order = W.partitionBy(*by).orderBy(p)
    m = F.count(p).over(W.partitionBy(*by))
    step = (m - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("step", step).withColumn("p_holm", F.least(F.max("step").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0))).drop("step")


def percent_of_window(df: DataFrame, window, by: list[str], value: str = "y") -> DataFrame:
    base = F.median(F.when(window.holds(F.col("t")), F.col(value))).over(W.partitionBy(*by))
    return df.withColumn(value, to_percent(F.col(value), base))
