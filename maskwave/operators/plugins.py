"""Functions of a user's own inside Spark's grouped maps: parameters of a trace's cycles, and preprocessors of a segment or a recording.

A group is one trace, segment or recording, which a recording's length bounds. What a function raises is a row's ``error`` with the
``error_stage`` where it arose; all other groups have their results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.protocol import Protocol
from ..sources.cells import KEY

#: compute(y, t, cycle) -> a number: a whole trace by time (NaN for missing) and the cycle that it is asked for.
Compute = Callable
TRACES = "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, y double, error string"
NAMES = [c.split()[0] for c in TRACES.split(", ")]


def named(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def parameters(traces: DataFrame, protocol: Protocol, functions: dict[str, Compute], by: list[str]) -> DataFrame:
    """by, cycle_index, and for each function ``<key>`` and ``<key>__error``: all functions of all cycles in one pass over a trace."""
    types = dict(traces.dtypes)
    columns = [f"`{k}` double, `{k}__error` string" for k in functions]
    schema = ", ".join([*[f"{k} {types[k]}" for k in by], "cycle_index int", *columns])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t_idx", kind="stable")
        y, t, ids = g["y"].to_numpy(float), g["t"].to_numpy(float), {k: g[k].iloc[0] for k in by}
        rows = []
        for cycle in protocol.cycles:
            row = {**ids, "cycle_index": cycle.index}
            for key, compute in functions.items():
                value, error = None, None
                try:
                    found = float(compute(y.copy(), t.copy(), cycle))
                    value = found if np.isfinite(found) else None
                except Exception as e:  # noqa: BLE001 - the user's function may raise anything
                    error = named(e)
                row |= {key: value, f"{key}__error": error}
            rows.append(row)
        return pd.DataFrame(rows).astype({k: float for k in functions})

    return traces.select(*by, "t_idx", "t", "y").groupBy(*by).applyInPandas(run, schema)


def guarded(run: Callable[[pd.DataFrame], pd.DataFrame], names: list[str], ids: list[str] | None = None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A grouped map that gives a row of ids and ``error`` for each segment of a group where ``run`` raises; else its rows, without an error."""
    ids = ids or [*KEY, "vessel_type"]

    def safe(g: pd.DataFrame) -> pd.DataFrame:
        try:
            out = run(g)
            return out.assign(error=None)[names]
        except Exception as e:  # noqa: BLE001 - one broken segment must not end the job
            out = g[ids].drop_duplicates().assign(error=named(e))
            return out.reindex(columns=names)

    return safe


def _grid(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, x, m) of one segment's rows: times, and times x loci with NaN where a cell is not observed."""
    x = g.assign(x=np.where(g["m"].to_numpy(bool), g["x"].to_numpy(float), np.nan)).pivot(index="t_idx", columns="locus", values="x").sort_index()
    t = g.drop_duplicates("t_idx").set_index("t_idx")["t"].sort_index().to_numpy(float)
    values = x.to_numpy(float)
    return t, values, np.isfinite(values)


def _rows(g: pd.DataFrame, y) -> pd.DataFrame:
    out = g.drop_duplicates("t_idx").sort_values("t_idx")[[*KEY, "vessel_type", "t_idx", "t"]].reset_index(drop=True)
    y = np.asarray(y, float)
    if y.shape != (len(out),):
        raise ValueError(f"a trace of shape {y.shape} for {len(out)} times")
    return out.assign(y=pd.Series([v if np.isfinite(v) else None for v in y], dtype=object).astype(float))


def segments(run: Callable) -> Callable[..., DataFrame]:
    """A preprocessor of ``run(t, x, m, protocol, **options) -> y``: a segment's times, its times x loci matrix and mask, and its trace."""

    def preprocess(cells: DataFrame, protocol: Protocol, **options) -> DataFrame:
        one = lambda g: _rows(g, run(*_grid(g), protocol, **options))
        out = cells.groupBy(*KEY).applyInPandas(guarded(one, NAMES), TRACES)
        return out.withColumn("y", F.when(~F.isnan("y"), F.col("y")))

    return preprocess


def recordings(run: Callable) -> Callable[..., DataFrame]:
    """A preprocessor of ``run(segments, protocol, **options) -> {label: y}`` for whole recordings: ``segments`` maps labels to (t, x, m). Where
    it raises, each segment of the recording has the error; a segment that it leaves out has one too."""

    def preprocess(cells: DataFrame, protocol: Protocol, **options) -> DataFrame:
        def one(g: pd.DataFrame) -> pd.DataFrame:
            parts = dict(iter(g.groupby("segment_label", sort=True)))
            found = run({k: _grid(p) for k, p in parts.items()}, protocol, **options)
            made = []
            for label, part in parts.items():
                mine = guarded(lambda p, k=label: _rows(p, found[k]), NAMES)
                made.append(mine(part))
            return pd.concat(made)

        def safe(g: pd.DataFrame) -> pd.DataFrame:
            try:
                return one(g)
            except Exception as e:  # noqa: BLE001
                return g[[*KEY, "vessel_type"]].drop_duplicates().assign(error=named(e)).reindex(columns=NAMES)

        out = cells.groupBy("subject_id", "visit_id").applyInPandas(safe, TRACES)
        return out.withColumn("y", F.when(~F.isnan("y"), F.col("y")))

    return preprocess
