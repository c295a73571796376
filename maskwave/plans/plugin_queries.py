"""Queries of a user's own functions: parameters of cycles, preprocessors of segments and recordings, and the errors that they raise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import biomarkers as B
from ..operators import evaluation as E
from ..operators import plugins as U
from .registry import IDS, SEG, TRACES_SQL, P, cells, cycle_bounds, query, rounded, traces

_WINDOWS = ", ".join("({k}, {bs}, {be}, {fs}, {fe}, {rs}, {re})".format(**cycle_bounds(c)) for c in P.cycles)
_CYCLES = f"w(cycle_index, bs, be, fs, fe, rs, re) AS (VALUES {_WINDOWS})"
LEAST = 19


def flicker_rise(y, t, cycle):
    """Mean of the flicker less that of the baseline; too few samples are an error."""
    inside = lambda w: y[(t >= w.start) & (t < w.end) & np.isfinite(y)]
    lit, rest = inside(cycle.flicker), inside(cycle.baseline)
    if len(lit) < LEAST:
        raise ValueError(f"{len(lit)} samples")
    return lit.mean() - rest.mean() if len(rest) else np.nan


@query(
    "user_parameters",
    TRACES_SQL
    + f""", {_CYCLES}, a AS (SELECT {IDS}, cycle_index, count(y) FILTER (t >= fs AND t < fe) AS n, avg(y) FILTER (t >= fs AND t < fe) - avg(y) FILTER (t >= bs AND t < be) AS rise, max(y) FILTER (t >= fs AND t < fe) AS top FROM tr, w GROUP BY ALL)
SELECT {IDS}, CAST(cycle_index AS INTEGER) AS cycle_index, n >= {LEAST} AS ok, CASE WHEN n < {LEAST} THEN 'ValueError: ' || n || ' samples' END AS error, CASE WHEN n < {LEAST} THEN 'compute:rise' END AS error_stage,
  round(CASE WHEN n >= {LEAST} THEN rise END, 6) AS rise, top AS max_dilation FROM a""",
)
def user_parameters(spark, sf_dir):
    """A function of the user's beside a declared parameter; cycles with too few samples have the function's error."""
    out = B.extract(traces(spark, sf_dir), P, (B.computed("rise", flicker_rise), B.DEFAULT_SET[0]))
    return rounded(out.select(*SEG, "cycle_index", "ok", "error", "error_stage", "rise", "max_dilation"), "rise")


def even_mean(t, x, m, protocol):
    """Mean over loci; a segment with an odd number of observed cells is refused."""
    if m.sum() % 2:
        raise ArithmeticError(f"{m.sum()} cells")
    n = m.sum(axis=1)
    return np.divide(np.where(m, x, 0).sum(axis=1), n, out=np.full(len(n), np.nan), where=n > 0)


_EVEN = "CASE WHEN n % 2 = 1 THEN {} END"


@query(
    "segment_errors",
    TRACES_SQL
    + f""", {_CYCLES}, n AS (SELECT {IDS}, count(x) AS n FROM cells GROUP BY ALL), mt AS (SELECT {IDS}, t, avg(x) AS y FROM cells GROUP BY ALL),
a AS (SELECT {IDS}, cycle_index, max(y) FILTER (t >= fs AND t < fe) AS top FROM mt, w GROUP BY ALL)
SELECT {IDS}, CAST(cycle_index AS INTEGER) AS cycle_index, n % 2 = 0 AS ok, {_EVEN.format("'ArithmeticError: ' || n || ' cells'")} AS error, {_EVEN.format("'preprocess:even_mean'")} AS error_stage, round(CASE WHEN n % 2 = 0 THEN top END, 6) AS max_dilation
FROM a JOIN n USING ({IDS})""",
)
def segment_errors(spark, sf_dir):
    """A preprocessor of the user's that refuses some segments: each of these has its error rows, all others their parameters."""
    E.register("even_mean", U.segments(even_mean))
    out = E.parameters(cells(spark, sf_dir), P, ("even_mean",), B.DEFAULT_SET[:1])
    return rounded(out.select(*SEG, "cycle_index", "ok", "error", "error_stage", "max_dilation"), "max_dilation")


def common_mode(segments, protocol):
    """Each segment's mean trace less that of all loci of the recording; a recording of one vessel kind alone is refused."""
    if len({label[0] for label in segments}) < 2:
        raise ValueError("one vessel kind")
    means = lambda x: np.divide(np.nansum(x, axis=1), n := np.isfinite(x).sum(axis=1), out=np.full(len(x), np.nan), where=n > 0)
    whole = means(np.hstack([x for _, x, _ in segments.values()]))
    return {label: means(x) - whole for label, (_, x, _) in segments.items()}


@query(
    "recording_preprocessor",
    TRACES_SQL
    + f""", k AS (SELECT subject_id, visit_id, count(DISTINCT segment_label[1]) AS kinds FROM cells GROUP BY ALL), w AS (SELECT subject_id, visit_id, t_idx, avg(x) AS whole FROM cells GROUP BY ALL), s AS (SELECT {IDS}, t_idx, avg(x) AS y FROM cells GROUP BY ALL)
SELECT {IDS}, t_idx, round(y - whole, 6) AS y, CAST(NULL AS VARCHAR) AS error FROM s JOIN w USING (subject_id, visit_id, t_idx) JOIN k USING (subject_id, visit_id) WHERE kinds > 1
UNION ALL SELECT DISTINCT {IDS}, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), 'ValueError: one vessel kind' FROM s JOIN k USING (subject_id, visit_id) WHERE kinds < 2""",
)
def recording_preprocessor(spark, sf_dir):
    """A preprocessor of the user's over whole recordings."""
    out = U.recordings(common_mode)(cells(spark, sf_dir), P)
    return rounded(out.select(*SEG, "t_idx", "y", F.col("error")), "y")
