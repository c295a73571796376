"""Denoisers that work on a segment's whole matrix. A group is one segment (or one vessel's segments of a recording): its size is that
of a recording, whatever their number. Everything before and after the matrix step is expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.missing import observed, to_percent
from ..functions.protocol import Protocol
from ..sources.cells import KEY
from . import aggregates as A
from . import kernels as K
from . import sequences as S
from .plugins import guarded


@dataclass(frozen=True)
class RpcaConfig:
    """Operating point of the masked decomposition; the defaults are those of the paper's extraction."""

    lam: float = 0.55
    mu: float = 1.0
    rho: float = 5.0
    gamma: float = 1000.0
    max_iter: int = 70
    tol: float = 1e-3
    scale: str = "global"
    standardize: bool = True
    fill: bool = False
    lowpass_extra: float | None = None
    support_frac: float | None = 0.75
    support_abs: int = 12
    harmonize: str | None = "percent_then_aggregate"
    hampel: bool = True
    baseline: str = "protocol_global"


COMPONENTS = "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, locus int, x double, m boolean, s double, a double, h double, iterations int, converged boolean, residual double, error string"
_PARTS = [c.split()[0] for c in COMPONENTS.split(", ")]


def _matrix(g: pd.DataFrame, value: str) -> np.ndarray:
    """loci x times of rows sorted by locus and time on a complete grid."""
    loci = g["locus"].nunique()
    return g[value].to_numpy(float).reshape(loci, len(g) // loci)


def decompose(cells: DataFrame, protocol: Protocol, config: RpcaConfig = RpcaConfig()) -> DataFrame:
    """Components s, a and h of every cell: standardised by baseline, split, and scaled back (the artefact without the centre). A segment that
    cannot be split is one row with its ``error`` and no times."""
    ref = protocol.reference(config.baseline)
    if config.fill:
        cells = S.interpolate(cells.withColumn("x", observed(F.col("x"), F.col("m"))), [*KEY, "vessel_type", "locus"], "x").withColumn("m", F.col("x").isNotNull())
    if config.standardize:
        cells = cells.join(A.center_and_scale(cells, ref, config.scale), [*KEY, "locus"])
    else:
        cells = cells.withColumns({"mu": F.lit(0.0), "sd": F.lit(1.0)})
    fs, extra = protocol.fs, config.lowpass_extra
    knobs = {k: v for k, v in asdict(config).items() if k in ("lam", "mu", "rho", "gamma", "max_iter", "tol")}

    def split(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["locus", "t_idx"], kind="stable").reset_index(drop=True)
        x, m = _matrix(g, "x"), _matrix(g, "m") > 0
        high = np.zeros_like(x)
        if extra is not None:
            with np.errstate(invalid="ignore"):
                there = m & np.isfinite(x)
                trace = np.divide(np.where(there, x, 0).sum(axis=0), there.sum(axis=0), out=np.full(x.shape[1], np.nan), where=there.any(axis=0))
            bpm = K.heartbeat(trace, fs)[0]
            if np.isfinite(bpm):
                parts = [K.lowpass_runs(row, on, fs, bpm / 60 + extra) for row, on in zip(x, m, strict=True)]
                x, high = np.array([p[0] for p in parts]), np.nan_to_num(np.array([p[1] for p in parts]))
        mu, sd = _matrix(g, "mu"), _matrix(g, "sd")
        own = {k: float(g[k].iloc[0]) for k in ("lam", "gamma") if k in g}  # levels of a grid
        s, a, info = K.masked_rpca((x - mu) / sd, m, **(knobs | own))
        g["s"], g["a"], g["h"] = (s * sd + np.nan_to_num(mu)).ravel(), (a * sd).ravel(), high.ravel()
        g["iterations"], g["converged"], g["residual"] = info["iterations"], info["converged"], info["residual"]
        return g

    return cells.groupBy(*KEY).applyInPandas(guarded(split, _PARTS), COMPONENTS)


def rpca_trace(cells: DataFrame, protocol: Protocol, config: RpcaConfig = RpcaConfig()) -> DataFrame:
    """The denoised trace of each segment in percent of its baseline, NULL where too few loci are observed."""
    parts = decompose(cells, protocol, config)
    ref = protocol.reference(config.baseline)
    enough = F.sum(F.col("m").cast("int")).over(W.partitionBy(*KEY, "t_idx")) >= A.min_valid(config.support_frac, config.support_abs, F.count(F.lit(1)).over(W.partitionBy(*KEY, "t_idx")))
    gated = parts.withColumn("ok", enough)
    if config.harmonize == "percent_then_aggregate":
        base = F.median(F.when(ref.holds(F.col("t")) & F.col("m"), F.col("s"))).over(W.partitionBy(*KEY, "locus"))
        gated = gated.withColumn("s", to_percent(F.col("s"), base))
    y = gated.groupBy(*KEY, "vessel_type", "t_idx", "t").agg(F.median(observed(F.col("s"), F.col("m"))).alias("y"), F.first("ok").alias("ok"), F.max("error").alias("error"))
    y = y.withColumn("y", F.when(F.col("ok"), F.col("y"))).drop("ok")
    if config.harmonize == "aggregate_then_percent":
        y = S.percent_of_window(y, ref, [*KEY, "vessel_type"])
    return S.hampel(y, [*KEY, "vessel_type"]).drop("outlier") if config.hampel else y


def joint(cells: DataFrame) -> DataFrame:
    """Loci of all segments of a recording's vessel side by side: joint_locus numbers them through, by label and locus."""
    wide = F.max("locus").over(W.partitionBy(*KEY)) + 1
    first = cells.withColumn("width", wide)
    place = first.select(*KEY, "vessel_type", "width").distinct().withColumn("before", F.coalesce(F.sum("width").over(W.partitionBy("subject_id", "visit_id", "vessel_type").orderBy("segment_label").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return cells.join(place.select(*KEY, "before"), KEY).withColumn("joint_locus", (F.col("before") + F.col("locus")).cast("int")).drop("before")


def group_rpca_trace(cells: DataFrame, protocol: Protocol, lam: float = 1e-2, mu: float = 1e-5, rho: float = 2.0, gamma: float = 10.0, max_iter: int = 70, tol: float = 1e-3, lowpass_extra: float | None = None, average: int | None = 25) -> DataFrame:
    """Arteries of a recording together, veins together: gaps filled, z-scores, decomposition without a mask, masked mean trace of each segment.

    Segments of a group must share one time grid. The artefact keeps the centre (``a`` is scaled back with it), unlike the segment's."""
    filled = S.interpolate(cells.withColumn("x", observed(F.col("x"), F.col("m"))), [*KEY, "vessel_type", "locus"], "x")
    wide, fs = joint(filled), protocol.fs

    def split(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["joint_locus", "t_idx"], kind="stable").reset_index(drop=True)
        loci = g["joint_locus"].nunique()
        x = g["x"].to_numpy(float).reshape(loci, len(g) // loci)
        if lowpass_extra is not None:
            # A heartbeat of each segment from its mean over observed loci, and their mean for the group.
            label = g["segment_label"].to_numpy().reshape(x.shape)[:, 0]
            seen = np.where(g["m"].to_numpy(bool).reshape(x.shape), x, np.nan)
            with np.errstate(invalid="ignore"):
                means = [np.nansum(seen[label == k], axis=0) / np.isfinite(seen[label == k]).sum(axis=0) for k in sorted(set(label))]
            rates = np.array([K.heartbeat(y, fs)[0] for y in means])
            if np.isfinite(rates).any():
                cutoff = float(np.nanmean(rates)) / 60 + lowpass_extra
                x = np.array([K.lowpass_runs(row, np.isfinite(row), fs, cutoff)[0] for row in x])
        mean = np.nanmean(x, axis=1, keepdims=True) if np.isfinite(x).any() else np.zeros((loci, 1))
        sd = np.nanstd(x, axis=1, keepdims=True)
        sd = np.where((sd > 0) & np.isfinite(sd), sd, 1.0)
        s, a, info = K.masked_rpca(np.nan_to_num((x - mean) / sd), np.ones(x.shape, bool), lam, mu, rho, gamma, max_iter, tol)
        g["s"], g["a"], g["h"] = (s * sd + np.nan_to_num(mean)).ravel(), (a * sd + np.nan_to_num(mean)).ravel(), 0.0
        g["iterations"], g["converged"], g["residual"] = info["iterations"], info["converged"], info["residual"]
        return g

    parts = wide.groupBy("subject_id", "visit_id", "vessel_type").applyInPandas(guarded(split, _PARTS), COMPONENTS)
    if average:
        parts = S.moving_mean(parts, [*KEY, "vessel_type", "locus"], average, "s")
    return parts.groupBy(*KEY, "vessel_type", "t_idx", "t").agg(F.avg(observed(F.col("s"), F.col("m"))).alias("y"), F.max("error").alias("error"))


def heartbeats(traces: DataFrame, fs: float, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Beats a minute and peak density of each trace."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t_idx")
        bpm, peak = K.heartbeat(g["y"].to_numpy(float), fs, low, high)
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in KEY}, "bpm": [bpm], "peak": [peak]})

    return traces.groupBy(*KEY).applyInPandas(one, "subject_id string, visit_id string, segment_label string, bpm double, peak double")


def lowpass_cells(cells: DataFrame, fs: float, cutoff: float) -> DataFrame:
    """Low-passed and remaining part of every locus, run by run; a task's group is a segment."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["locus", "t_idx"]).reset_index(drop=True)
        parts = [K.lowpass_runs(p["x"].to_numpy(float), p["m"].to_numpy(bool), fs, cutoff) for _, p in g.groupby("locus", sort=True)]
        g["low"], g["rest"] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return g[[*KEY, "t_idx", "locus", "low", "rest"]]

    return cells.groupBy(*KEY).applyInPandas(one, "subject_id string, visit_id string, segment_label string, t_idx int, locus int, low double, rest double")


def cardiac_band(cells: DataFrame, protocol: Protocol, source: str = "protocol_global", width: float = 1.0, floor: float = 0.3) -> DataFrame:
    """cardiac and noise of every cell: the band around the segment's heartbeat in its baseline (a difference of two low-passes, the lower
    one not under ``floor`` Hz), and, in the baseline, what is left of the cell beside its locus's median and that band.

    Without a heartbeat the band is zero where a cell is observed. Outside the baseline noise is NULL."""
    ref, fs = protocol.reference(source), protocol.fs

    def split(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["locus", "t_idx"], kind="stable").reset_index(drop=True)
        x, m = _matrix(g, "x"), _matrix(g, "m") > 0
        there = m & np.isfinite(x)
        t = _matrix(g, "t")[0]
        rest = (t >= ref.start) & (t < ref.end)
        seen = np.where(there, x, np.nan)
        with np.errstate(invalid="ignore"):
            bpm = K.heartbeat(np.nansum(seen[:, rest], axis=0) / there[:, rest].sum(axis=0), fs)[0]
        if np.isfinite(bpm):
            low, high = (np.array([K.lowpass_runs(row, on, fs, c)[0] for row, on in zip(x, there, strict=True)]) for c in (max(floor, bpm / 60 - width / 2), bpm / 60 + width / 2))
            band = high - low
        else:
            band = np.where(there, 0.0, np.nan)
        noise = np.full(x.shape, np.nan)
        for k in range(len(x)):
            inside = seen[k, rest]
            if np.isfinite(inside).any():
                noise[k, rest] = inside - np.nanmedian(inside) - band[k, rest]
        g["cardiac"], g["noise"] = band.ravel(), noise.ravel()
        return g[[*KEY, "t_idx", "locus", "cardiac", "noise"]]

    out = cells.groupBy(*KEY).applyInPandas(split, "subject_id string, visit_id string, segment_label string, t_idx int, locus int, cardiac double, noise double")
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in ("cardiac", "noise")})


def notched_average(traces: DataFrame, fs: float, half: float = 0.2) -> DataFrame:
    """Each trace with its own heartbeat removed by a band-stop; unchanged where there is none or a value is missing."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t_idx")
        y = g["y"].to_numpy(float)
        bpm = K.heartbeat(y, fs)[0]
        if np.isfinite(bpm) and np.isfinite(y).all() and 0 < bpm / 60 - half and bpm / 60 + half < fs / 2:
            y = K.bandstop(y, fs, bpm / 60 - half, bpm / 60 + half)
        return g.assign(y=y)[[*KEY, "t_idx", "y"]]

    return traces.groupBy(*KEY).applyInPandas(one, "subject_id string, visit_id string, segment_label string, t_idx int, y double")


def effective_rank(matrix: DataFrame, by: list[str], row: str, column: str, value: str) -> DataFrame:
    """Variance shares of the first two components of each group's matrix: its complete rows, centred by column.

    Tasks add up products of columns; what meets in one place is a square of the columns for each task and group, not the rows."""
    types = dict(matrix.dtypes)
    kinds = ", ".join(f"{k} {types[k]}" for k in by)
    width = matrix.groupBy(*by).agg(F.count_distinct(column).alias("width"))
    there = F.count_if(F.col(value).isNotNull() & ~F.isnan(value))
    vectors = matrix.groupBy(*by, row).agg(F.array_sort(F.collect_list(F.struct(column, value))).alias("v"), there.alias("there")).join(width, by)
    vectors = vectors.select(*by, "width", F.when(F.col("there") == F.col("width"), F.transform("v", lambda x: x[value].cast("double"))).alias("v"))

    def add(batches):
        sums: dict[tuple, list] = {}
        for g in batches:
            for key, part in g.groupby(by, dropna=False, sort=False):
                size = int(part["width"].iloc[0])
                whole = [v for v in part["v"] if v is not None]
                x = np.array(whole, float).reshape(len(whole), size)
                old = sums.get(key)
                new = [len(x), x.sum(axis=0), x.T @ x]
                sums[key] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]
        rows = [(*k, n, s.tolist(), p.ravel().tolist()) for k, (n, s, p) in sums.items()]
        yield pd.DataFrame(rows, columns=[*by, "n", "sums", "products"])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(np.stack(g["sums"].to_list()), axis=0)
        r = K.rank_of_sums(int(g["n"].sum()), sums, np.sum(np.stack(g["products"].to_list()), axis=0).reshape(len(sums), len(sums)))
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in by}, "pc1": [r["pc1"]], "pc2": [r["pc2"]], "n_loci": [r["n_loci"]], "n_samples": [r["n_samples"]]})

    partial = vectors.mapInPandas(add, f"{kinds}, n long, sums array<double>, products array<double>")
    return partial.groupBy(*by).applyInPandas(one, f"{kinds}, pc1 double, pc2 double, n_loci int, n_samples int")
