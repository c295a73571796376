"""Trace denoisers that windows and expressions can express: running medians, cycle templates, polynomials."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.missing import to_percent
from ..functions.protocol import Protocol
from ..sources.cells import KEY
from . import sequences as S

BY = [*KEY, "vessel_type"]


def kotliar_smooth(traces: DataFrame, protocol: Protocol, seconds: float = 4.0, inside_only: bool = False) -> DataFrame:
    """Percent of the reference baseline, then the running median; optionally NULL outside cycles."""
    out = S.percent_of_window(traces, protocol.reference(), BY)
    out = S.kotliar_median(out, BY, protocol.fs, seconds)
    if inside_only:
        held = F.lit(False)
        for c in protocol.cycles:
            start = c.baseline.start if c.baseline else c.flicker.start - 30
            held = held | ((F.col("t") >= start) & (F.col("t") < c.recovery.end))
        out = out.withColumn("y", F.when(held, F.col("y")))
    return out


def kotliar_template(traces: DataFrame, protocol: Protocol, seconds: float = 4.0) -> DataFrame:
    """Each cycle in percent of its own baseline, median over cycles cut to the shortest, running median, and the result at each cycle's place."""
    stacked = S.stack_cycles(traces, protocol, BY)
    base = F.lit(None).cast("double")
    for c in protocol.cycles:
        inside = (F.col("cycle_index") == c.index) & protocol.baseline_of(c).holds(F.col("t"))
        base = F.coalesce(base, F.median(F.when(inside, F.col("y"))).over(W.partitionBy(*BY, "cycle_index")))
    percent = stacked.withColumn("y", to_percent(F.col("y"), base))
    template = S.cycle_template(percent, BY).withColumnRenamed("offset", "t_idx")
    smooth = S.kotliar_median(template, BY, protocol.fs, seconds).withColumnRenamed("t_idx", "offset")
    return S.tile(smooth, stacked, traces, BY)


def sms(traces: DataFrame, protocol: Protocol, seconds: float = 4.0) -> DataFrame:
    """Centred running median, then percent of the reference baseline."""
    smooth = S.centred_median(traces, BY, max(1, round(seconds * protocol.fs)))
    return S.percent_of_window(smooth, protocol.reference(), BY)


def sms_average(traces: DataFrame, protocol: Protocol, seconds: float = 4.0) -> DataFrame:
    """The same, then the median over cycles at each cycle's place."""
    smooth = sms(traces, protocol, seconds)
    stacked = S.stack_cycles(smooth, protocol, BY)
    return S.tile(S.cycle_template(stacked, BY), stacked, traces, BY)


def polynomial(traces: DataFrame, protocol: Protocol, degree: int = 4, per_cycle: bool = False) -> DataFrame:
    """Percent of baseline, fitted by a polynomial over the samples that are there, given at every sample of the fit's range.

    The sums of powers of scaled time are plain aggregates; a task then solves one small system a segment (or cycle)."""
    names = [f"p{k}" for k in range(2 * degree + 1)] + [f"b{k}" for k in range(degree + 1)]
    out = None
    parts = [(protocol.reference(), -float("inf"), float("inf"))]
    if per_cycle:
        parts = [(None, (c.baseline.start if c.baseline else c.flicker.start - 30), c.recovery.end) for c in protocol.cycles]
    for k, (window, start, end) in enumerate(parts):
        part = traces
        if window is not None:
            base = F.median(F.when(window.holds(F.col("t")), F.col("y"))).over(W.partitionBy(*BY))
        else:
            on = protocol.cycles[k].flicker.start
            base = F.median(F.when((F.col("t") >= on - 30) & (F.col("t") < on - 5), F.col("y"))).over(W.partitionBy(*BY))
        part = part.withColumn("y", to_percent(F.col("y"), base))
        if per_cycle:
            part = part.where((F.col("t") >= start) & (F.col("t") < end))
        low, high = F.min("t").over(W.partitionBy(*BY)), F.max("t").over(W.partitionBy(*BY))
        part = part.withColumn("u", F.when(high > low, 2 * (F.col("t") - low) / (high - low) - 1).otherwise(0.0))
        held = F.when(F.col("y").isNotNull(), F.col("u"))
        sums = part.groupBy(*BY).agg(*[F.sum(F.pow(held, F.lit(j))).alias(f"p{j}") for j in range(2 * degree + 1)], *[F.sum(F.col("y") * F.pow(held, F.lit(j))).alias(f"b{j}") for j in range(degree + 1)])

        @F.pandas_udf("array<double>")
        def solve(*columns: pd.Series) -> pd.Series:
            table = np.column_stack([c.to_numpy(float) for c in columns])
            found = []
            for row in table:
                ok = np.isfinite(row).all() and row[0] >= degree + 1
                a = np.array([[row[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
                found.append(np.linalg.solve(a, row[2 * degree + 1 :]).tolist() if ok and np.linalg.matrix_rank(a) == degree + 1 else None)
            return pd.Series(found)

        fit = part.join(sums.select(*BY, solve(*names).alias("c")), BY)
        value = sum((F.col("c")[j] * F.pow("u", F.lit(j)) for j in range(degree + 1)), F.lit(0.0))
        fit = fit.select(*BY, "t_idx", "t", value.alias("y"))
        out = fit if out is None else out.unionByName(fit)
    if per_cycle:
        out = traces.select(*BY, "t_idx", "t").join(out.drop("t"), [*BY, "t_idx"], "left")
    return out
