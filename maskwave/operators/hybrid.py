"""Semi-synthetic recordings with known truth: response templates on the residual noise of real baselines.

Draws are hashes of seed, segment, configuration and purpose, so every sample is the same whatever the order and the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.missing import observed
from ..functions.protocol import Protocol, any_of
from ..sources.cells import KEY
from . import kernels as K

# Knots of the normalised response (seconds after flicker onset, share of the peak).
ARTERY_DILATION = (
    (-15, -10, -5, -1, 0, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 30, 33, 37, 42, 50, 55),
    (0, 0, 0, 0, 0, 0.04, 0.14, 0.30, 0.50, 0.68, 0.82, 0.91, 0.96, 0.99, 1.0, 1.0, 0.98, 0.93, 0.85, 0.72, 0.55, 0.38, 0.22, 0.10, 0.02, 0, 0, 0, 0, 0),
)
ARTERY_CONSTRICTION = (
    (-15, -10, 0, 20, 23, 25, 27, 29, 31, 33, 35, 37, 40, 44, 48, 50, 55),
    (0, 0, 0, 0, 0.02, 0.10, 0.30, 0.60, 0.85, 1.0, 0.95, 0.82, 0.55, 0.25, 0.08, 0.02, 0),
)
VEIN_DILATION = (
    (-15, -10, -5, -1, 0, 1, 3, 5, 8, 10, 13, 16, 18, 20, 22, 24, 26, 28, 30, 35, 40, 45, 50, 55),
    (0, 0, 0, 0, 0, 0.10, 0.25, 0.38, 0.53, 0.63, 0.75, 0.85, 0.93, 0.98, 1.0, 0.88, 0.70, 0.53, 0.35, 0.10, 0.01, 0, 0, 0),
)


@dataclass(frozen=True)
class Artefacts:
    """Events a minute, mean and deviation of their size in units of x, relative jitter of loci, share that is positive, frames of a burst."""

    impulse_rate: float = 2.0
    impulse_mean: float = 15.0
    impulse_sd: float = 8.0
    impulse_jitter: float = 0.15
    burst_rate: float = 0.8
    burst_mean: float = 12.0
    burst_sd: float = 6.0
    burst_jitter: float = 0.10
    positive: float = 0.6
    shortest: int = 3
    longest: int = 15


def uniform(seed: int, *parts) -> Column:
    """A number in [0, 1) from the hash of the parts."""
    h = F.xxhash64(F.lit(seed), *[F.lit(p) if isinstance(p, (str, int)) else p for p in parts])
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def normal(seed: int, *parts) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, "r", *parts))) * F.cos(2 * float(np.pi) * uniform(seed, "a", *parts))


def curve(t: Column, knots) -> Column:
    """The monotone cubic through the knots, zero outside them and nowhere negative."""
    x, y = np.array(knots[0], float), np.array(knots[1], float)
    # The interval is looked up in constant arrays, each a text that the optimiser folds: one small expression, whatever the number of knots.
    fixed = lambda values: F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")
    at = F.least(F.size(F.filter(fixed(x), lambda k: k <= t)), F.lit(len(x) - 1)) - 1
    c = [F.get(fixed(column), at) for column in K.pchip(x, y).T]
    d = t - F.get(fixed(x), at)
    cubic = ((c[3] * d + c[2]) * d + c[1]) * d + c[0]
    return F.when((t >= float(x[0])) & (t <= float(x[-1])), F.greatest(cubic, F.lit(0.0))).otherwise(0.0)


def response(t: Column, artery: Column, protocol: Protocol, amplitude, depth, shift) -> Column:
    """The response in percent: amplitude, depth and shift are functions of the cycle's index."""
    parts = []
    for c in protocol.cycles:
        rel = t - float(c.flicker.start) - shift(c.index)
        art = amplitude(c.index) * curve(rel, ARTERY_DILATION) - depth(c.index) * curve(rel, ARTERY_CONSTRICTION)
        active = (t >= c.flicker.start - 2.0) & (t < float(c.recovery.end))
        parts.append(F.when(active, F.when(artery, art).otherwise(amplitude(c.index) * curve(rel, VEIN_DILATION))).otherwise(0.0))
    return reduce(lambda a, b: a + b, parts)


def artefact(a: Artefacts, seed: int, fs: float, unit: list[Column], t_idx: Column, locus: Column) -> Column:
    """Impulses of one frame and bursts of several, each on all loci at once with a size of its own for each locus.

    Whether an event starts at a frame is a hash of unit and frame, so a frame knows the bursts that reach it from the frames before it:
    no join, no window. At most one event of a kind starts at a frame; a burst goes on to its end or to the end of the recording."""

    def size(kind: str, start: Column, mean: float, sd: float, jitter: float) -> Column:
        base = F.greatest(F.lit(0.0), mean + sd * normal(seed, kind + "-size", *unit, start))
        own = F.greatest(F.lit(0.0), base * (1 + jitter * normal(seed, kind + "-locus", *unit, start, locus)))
        return F.when(uniform(seed, kind + "-sign", *unit, start) < a.positive, own).otherwise(-own)

    def burst(back: Column) -> Column:
        start = t_idx - back
        frames = a.shortest + F.floor((a.longest - a.shortest + 1) * uniform(seed, "burst-frames", *unit, start))
        on = (start >= 0) & (uniform(seed, "burst", *unit, start) < a.burst_rate / 60 / fs) & (frames > back)
        return F.when(on, size("burst", start, a.burst_mean, a.burst_sd, a.burst_jitter)).otherwise(0.0)

    impulse = F.when(uniform(seed, "impulse", *unit, t_idx) < a.impulse_rate / 60 / fs, size("impulse", t_idx, a.impulse_mean, a.impulse_sd, a.impulse_jitter)).otherwise(0.0)
    return impulse + F.aggregate(F.sequence(F.lit(0), F.lit(a.longest - 1)), F.lit(0.0), lambda sum_, back: sum_ + burst(back))


def baseline_residual(cells: DataFrame, protocol: Protocol) -> DataFrame:
    """What baselines hold beside each locus's median in its window, blocks one after the other: columns block, n_block, residual, rest."""
    windows = protocol.phase("baseline")
    number = F.lit(None).cast("int")
    for k, w in enumerate(windows):
        number = F.coalesce(F.when(w.holds(F.col("t")), F.lit(k)), number)
    held = cells.where(any_of(F.col("t"), windows)).withColumn("x", observed(F.col("x"), F.col("m"))).withColumn("w", number)
    by = [*KEY, "locus"]
    out = held.withColumns({"residual": F.col("x") - F.median("x").over(W.partitionBy(*by, "w")), "rest": F.median("x").over(W.partitionBy(*by)), "block": (F.row_number().over(W.partitionBy(*by).orderBy("t_idx")) - 1).cast("int"), "n_block": F.count(F.lit(1)).over(W.partitionBy(*by)).cast("int")})
    return out.select(*by, "block", "n_block", "residual", "rest")


def configurations(cells: DataFrame, n: int) -> DataFrame:
    """Every segment with every configuration number: a row generator, not a join."""
    return cells.select(*KEY, "vessel_type").distinct().withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def build(cells: DataFrame, protocol: Protocol, n_configs: int = 10, seed: int = 0, variability: float = 0.0, jitter: int = 2, drift: float = 0.0, multipliers: tuple[float, ...] | None = None, artefacts: Artefacts | None = None, scaled_residual: bool = False, sweep: tuple[str, tuple[float, ...]] | None = None, factors: DataFrame | None = None) -> DataFrame:
    """Hybrid cells with truth: baseline * (1 + response / 100) + residual, with per-cycle, per-locus and per-sample hashes as draws.

    ``variability``: deviation of loci's amplitudes; ``jitter``: largest shift of a locus in samples; ``drift``: slow sine in percent;
    ``multipliers``: factors of the cycles' amplitudes (attenuated or uneven responses); ``artefacts``: impulses and bursts (``artefact``);
    ``scaled_residual``: noise grows with the response; ``sweep``: a knob (drift, variability, or attenuation, the factor of the last cycle) and its
    levels, each of which every segment and configuration gets, in the column level, with the same draws; ``factors``: m0, m1, ... of each segment
    (KEY) as factors of its cycles. The mask is that of the tiled residual, less dark flicker frames. Truth is the median over
    the observed loci."""
    from .sequences import dark_frames

    conf = configurations(cells, n_configs)
    knob, levels = sweep or (None, ())
    if knob not in (None, "drift", "variability", "attenuation"):
        raise ValueError(f"no sweep over {knob}")
    conf = conf.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))) if sweep else conf.withColumn("level", F.lit(None).cast("double"))
    if factors is not None:
        conf = conf.join(factors.select(*KEY, *[f"m{c.index}" for c in protocol.cycles]), KEY)
    unit = [F.col(k) for k in KEY] + [F.col("config")]
    draw = lambda lo, hi, *p: lo + (hi - lo) * uniform(seed, *p, *unit)
    artery = F.lower("vessel_type").startswith("a")
    conf = conf.withColumns({"amp": F.when(artery, draw(1.0, 6.0, "amp")).otherwise(draw(2.0, 7.0, "amp")), "shf": draw(-2.0, 2.0, "shf"), "cut": uniform(seed, "cut", *unit), **{f"wobble{c.index}": 1 + 0.1 * normal(seed, "cycle", c.index, *unit) for c in protocol.cycles}})
    # Strong dilators constrict little: the depth falls with the amplitude.
    conf = conf.withColumn("dep", F.when(artery, F.greatest(F.lit(0.3), 3.5 - 0.5 * (F.col("amp") - 1.0) + 0.3 * normal(seed, "dep", *unit))).otherwise(0.0))
    times = cells.select(*KEY, "t_idx", "t", "locus").distinct()
    grid = conf.join(times, KEY)
    residual = baseline_residual(cells, protocol)
    size = residual.groupBy(*KEY, "locus").agg(F.first("n_block").alias("n_block"), F.first("rest").alias("rest"))
    grid = grid.join(size, [*KEY, "locus"]).withColumn("block", F.pmod(F.col("t_idx") - F.floor(F.col("cut") * F.col("n_block")).cast("int"), F.col("n_block")).cast("int"))
    grid = grid.join(residual.select(*KEY, "locus", "block", "residual"), [*KEY, "locus", "block"], "left")
    locus = [*unit, F.col("locus")]
    lag = F.floor((2 * jitter + 1) * uniform(seed, "lag", *locus)) - jitter if jitter else F.lit(0)
    grid = grid.withColumn("lag", lag.cast("int")).withColumn("gain", 1 + (F.col("level") if knob == "variability" else F.lit(float(variability))) * normal(seed, "gain", *locus))
    step = 1.0 / protocol.fs
    last = max((c.index for c in protocol.cycles), default=-1)
    fixed = lambda k: F.col(f"m{k}") if factors is not None else F.lit(float(multipliers[k]) if multipliers else 1.0)
    factor = lambda k: fixed(k) * F.col("level") if knob == "attenuation" and k == last else fixed(k)
    curve_ = response(F.col("t") - F.col("lag") * step, artery, protocol, lambda k: F.col("amp") * F.col(f"wobble{k}") * factor(k), lambda k: F.col("dep") * F.col(f"wobble{k}") * factor(k), lambda k: F.col("shf"))
    grid = grid.withColumn("pct", F.col("gain") * curve_)
    slow = F.col("level") if knob == "drift" else F.lit(float(drift))
    drifted = F.col("pct") + slow * F.sin(2 * float(np.pi) * 0.05 * F.col("t"))
    spike = artefact(artefacts, seed, protocol.fs, unit, F.col("t_idx"), F.col("locus")) if artefacts else F.lit(0.0)
    grid = grid.withColumn("m", F.col("residual").isNotNull() & F.col("rest").isNotNull() & dark_frames(grid, protocol, [*KEY, "config", "level"]))
    grow = 1 + drifted / 100 if scaled_residual else F.lit(1.0)
    grid = grid.withColumn("x", F.when(F.col("m"), F.col("rest") * (1 + drifted / 100) + F.col("residual") * grow + spike))
    truth = F.median(F.when(F.col("m"), F.col("pct"))).over(W.partitionBy(*KEY, "config", "level", "t_idx"))
    return grid.withColumn("truth", truth).select(*KEY, "vessel_type", "config", *(["level"] if sweep else []), "t_idx", "t", "locus", "x", "m", "truth")


def simple_response(t: Column, protocol: Protocol, seed: int, unit: list[Column]) -> Column:
    """A response without knots, in percent: a logistic rise in each flicker, an exponential return with an undershoot in its recovery."""
    parts = []
    for c in protocol.cycles:
        draw = lambda lo, hi, what, k=c.index: lo + (hi - lo) * uniform(seed, "simple", what, k, *unit)
        amp, depth = draw(2.0, 5.0, "amp"), draw(0.5, 2.0, "depth")
        up, down = t - float(c.flicker.start), t - float(c.flicker.end)
        rise = amp / (1 + F.exp(2.0 - up / draw(3.0, 8.0, "rise")))
        back = amp * F.exp(-down / draw(5.0, 15.0, "back")) - depth * (1 - F.exp(-down / 5.0)) * F.exp(-down / 30.0)
        parts.append(F.when(c.flicker.holds(t), rise).when((down >= 0) & (t < float(c.recovery.end)), back).otherwise(0.0))
    return reduce(lambda a, b: a + b, parts)


def build_simple(cells: DataFrame, protocol: Protocol, n_configs: int = 1, seed: int = 0) -> DataFrame:
    """Hybrids of ``simple_response``: each locus's median in the reference baseline, times 1 + response / 100, with that baseline's residual
    repeated from the first frame on; the mask stays the recording's own, and missing residuals count as zero. Columns as of ``build``."""
    by = [*KEY, "locus"]
    held = cells.where(protocol.reference().holds(F.col("t"))).withColumn("x", observed(F.col("x"), F.col("m")))
    rest = F.median("x").over(W.partitionBy(*by))
    held = held.select(*by, (F.row_number().over(W.partitionBy(*by).orderBy("t_idx")) - 1).cast("int").alias("block"), F.count(F.lit(1)).over(W.partitionBy(*by)).cast("int").alias("n_block"), rest.alias("rest"), (F.col("x") - rest).alias("residual"))
    size = held.groupBy(*by).agg(F.first("n_block").alias("n_block"), F.first("rest").alias("rest"))
    grid = cells.select(*KEY, "vessel_type", "t_idx", "t", "locus", "m").join(size, by).withColumn("block", F.pmod("t_idx", "n_block").cast("int"))
    grid = grid.join(held.select(*by, "block", "residual"), [*by, "block"], "left").withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(n_configs - 1))))
    grid = grid.withColumn("truth", simple_response(F.col("t"), protocol, seed, [*map(F.col, KEY), F.col("config")]))
    x = F.when(F.col("m"), F.col("rest") * (1 + F.col("truth") / 100) + F.coalesce("residual", F.lit(0.0)))
    out = grid.withColumn("x", x).withColumn("m", F.col("x").isNotNull())
    return out.select(*KEY, "vessel_type", "config", "t_idx", "t", "locus", "x", "m", "truth")


def as_segments(hybrid: DataFrame) -> DataFrame:
    """Each configuration as a visit of its own, so every cell operator takes hybrids as they are."""
    return hybrid.withColumn("visit_id", F.concat_ws("#", "visit_id", F.col("config").cast("string"))).drop("config")
