"""Tables that plots are drawn from, as wide as a screen whatever the recording: each pixel keeps what a line or a surface shows there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import observed
from ..functions.protocol import Protocol
from ..sources.cells import KEY
from .aggregates import aggregate_loci, colour_range
from .ranking import same
from .sequences import causal_median


def pixel(t: Column, start: float, end: float, pixels: int) -> Column:
    """The pixel of a time in [start, end)."""
    return F.least(F.floor((t - start) / (end - start) * pixels), F.lit(pixels - 1)).cast("int")


def _between(t: Column, start: float, end: float) -> Column:
    if end <= start:
        raise ValueError("the end must come after the start")
    return (t >= start) & (t < end)


def line(series: DataFrame, by: list[str], start: float, end: float, pixels: int, value: str = "y") -> DataFrame:
    """by, pixel, t, value: the first, last, lowest and highest point of each series in each pixel, once each, so that lines between them
    cover the same screen as the whole series. Missing values are no points; a pixel of missing values alone has none (a gap).

    One aggregate of four structs a pixel; of equal values the earliest point stands for both ends."""
    v, t = F.col(value), F.col("t")
    seen = series.where(_between(t, start, end) & v.isNotNull()).withColumn("pixel", pixel(t, start, end, pixels))
    point = F.struct(t.alias("t"), v.alias(value))
    picks = [F.min_by(point, t), F.max_by(point, t), F.min_by(point, F.struct(v, t)), F.max_by(point, F.struct(v, -t))]
    four = seen.groupBy(*by, "pixel").agg(*[p.alias(f"p{k}") for k, p in enumerate(picks)])
    points = F.array_sort(F.array_distinct(F.array("p0", "p1", "p2", "p3")))
    return four.select(*by, "pixel", F.explode(points).alias("p")).select(*by, "pixel", "p.t", f"p.{value}")


def surface(cells: DataFrame, start: float, end: float, pixels: int) -> DataFrame:
    """KEY, row (the locus, from 1), pixel, low, high, n, and the segment's colour range: what a surface of loci over time shows; a pixel
    without an observed cell has NULLs, so gaps stay gaps. A segment without any observed cell has no range."""
    here = cells.where(_between(F.col("t"), start, end)).withColumn("z", observed(F.col("x"), F.col("m")))
    tiles = here.withColumn("pixel", pixel(F.col("t"), start, end, pixels)).groupBy(*KEY, (F.col("locus") + 1).alias("row"), "pixel")
    tiles = tiles.agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count("z").alias("n"))
    ranges = colour_range(here.where(F.col("z").isNotNull()), KEY, "z").withColumnsRenamed({"low": "range_low", "high": "range_high"})
    return same(tiles, ranges, KEY, "left")


def triage(cells: DataFrame, protocol: Protocol, smooth_sec: float = 1.0, start: float | None = None, end: float | None = None, pixels: int = 1100) -> DataFrame:
    """KEY, series (raw or smooth), pixel, t, y: the median over loci and its causal running median, as ``line`` reduces them."""
    raw = aggregate_loci(cells).select(*KEY, "t_idx", "t", "y")
    w = max(1, round(smooth_sec * protocol.fs))
    smooth = causal_median(raw, KEY, w) if w > 1 else raw
    both = raw.withColumn("series", F.lit("raw")).unionByName(smooth.withColumn("series", F.lit("smooth")))
    return line(both, [*KEY, "series"], 0.0 if start is None else start, protocol.end() if end is None else end, pixels)


def shading(protocol: Protocol) -> list[tuple[float, float, str]]:
    """(start, end, phase) of the rectangles behind a plot; the global baseline by that name, without the one at the end."""
    rest = [(w.start, w.end, w.phase) for c in protocol.cycles for w in c.windows()]
    first = protocol.global_baseline
    return [(float(first.start), float(first.end), "global_baseline"), *rest] if first else rest
