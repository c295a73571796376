"""Per-cycle biomarkers of one-dimensional traces, as Spark aggregates, and the extraction of tables of them.

The protocol is a driver-side constant of a few windows, so a cycle's measures are conditional aggregates over the samples near
it. Missing values are skipped. A window without samples is an error; one with only missing values is not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.missing import statistic
from ..functions.protocol import Protocol
from ..sources.cells import KEY
from . import plugins

TRACE = [*KEY, "vessel_type", "method"]


def _y() -> Column:
    return F.col("y")


def _t() -> Column:
    return F.col("t")


def _i() -> Column:
    return F.col("t_idx")


def inside(start: Column | float, end: Column | float) -> Column:
    return (_t() >= start) & (_t() < end)


def level(at: Column, stat: str = "median") -> Column:
    """Mean, median, max or min of the samples of a window: baselines, dilations and constrictions."""
    return statistic(F.when(at, _y()), stat)


def first_max_time(at: Column) -> Column:
    """Time of the first largest value."""
    return F.max_by(F.when(at & _y().isNotNull(), _t()), F.when(at & _y().isNotNull(), F.struct(_y(), -_i())))


def first_min_time(at: Column) -> Column:
    return F.min_by(F.when(at & _y().isNotNull(), _t()), F.when(at & _y().isNotNull(), F.struct(_y(), _i())))


def value_from(t_end: Column) -> Column:
    """The value at the first sample at or after a time; NULL if it is missing there."""
    return F.min_by(_y(), F.when(_t() >= t_end, _i()))


def percent_of(value: Column, base: Column) -> Column:
    return F.when(base.isNotNull() & (base != 0), (value - base) / base * 100)


def slope(rise: Column, run: Column) -> Column:
    return F.when(run > 0, rise / run)


def trapezoid(start: Column, end: Column, f=lambda y: y) -> Column:
    """Area between a sample and the one before it that is there, if both lie in the window; needs columns pt and py."""
    return F.when(inside(start, end) & _y().isNotNull() & (F.col("pt") >= start), (_t() - F.col("pt")) * (f(_y()) + f(F.col("py"))) / 2)


def spread(traces: DataFrame, protocol: Protocol) -> DataFrame:
    """Each sample once for every cycle that needs it, with the bounds of the cycle's windows: no join, the protocol is a constant."""
    names = ("cycle_index", "bs", "be", "fs", "fe", "rs", "re")
    rows = []
    for c in protocol.cycles:
        base = protocol.baseline_of(c)
        values = (c.index, base.start, base.end, c.flicker.start, c.flicker.end, c.recovery.start, c.recovery.end)
        rows.append(F.struct(*[F.lit(v if n == "cycle_index" else float(v)).alias(n) for n, v in zip(names, values, strict=True)]))
    near = F.filter(F.array(*rows), lambda c: ((_t() >= c["bs"]) & (_t() < c["be"])) | ((_t() >= c["fs"] - 21) & (_t() < c["re"] + 81)))
    return traces.withColumn("c", F.explode(near)).select(*TRACE, "t_idx", "t", "y", *[F.col(f"c.{n}").alias(n) for n in names])


def biomarkers(traces: DataFrame, protocol: Protocol) -> DataFrame:
    """One row a trace and cycle with every measure; a cycle without any sample near it has none.

    Everything is keyed by trace and cycle: one shuffle, one sort, window values for what other measures depend on (baseline, extremes
    and their times), and one aggregate on the same keys."""
    keys = [*TRACE, "cycle_index"]
    whole, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("t_idx")
    bs, be, fs, fe, rs, re = (F.col(n) for n in ("bs", "be", "fs", "fe", "rs", "re"))
    base, fl, ext, rec = inside(bs, be), inside(fs, fe), inside(fs, fe + 10), inside(rs, re)
    bd = F.col("bd")
    rows = spread(traces, protocol)
    seen = F.when(_y().isNotNull(), F.struct(_t().alias("t"), _y().alias("y")))
    rows = rows.withColumn("before", F.last(seen, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumns({"pt": F.col("before.t"), "py": F.col("before.y")})
    rows = rows.withColumns({"bd": level(base).over(whole), "top": level(fl, "max").over(whole), "top_ext": level(ext, "max").over(whole), "at_max": first_max_time(fl).over(whole), "at_min": first_min_time(rec).over(whole)})
    over = lambda y: F.when(bd.isNotNull(), F.greatest(y - bd, F.lit(0.0)))
    under = lambda y: F.when(bd.isNotNull(), F.greatest(bd - y, F.lit(0.0)))
    rows = rows.withColumn("step", trapezoid(fs, re, over))
    rows = rows.withColumns({"cum": F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("step").over(whole)})
    near = lambda at: (_t() >= F.col(at) - 2) & (_t() < F.col(at) + 2)
    rise = lambda top: _y() >= bd + 0.3 * (F.col(top) - bd)
    aggs = {
        "baseline_dynamic": level(inside(fs - 20, fs), "mean"),
        "bd": F.first("bd"),
        "baseline_max": level(base, "max"),
        "baseline_min": level(base, "min"),
        "dil_max": F.first("top"),
        "dil_max_ext": F.first("top_ext"),
        "dil_max_t": F.first(F.col("at_max") - fs),
        "dil_max_t_ext": first_max_time(ext) - F.first(fs),
        "dil_max_1": level(inside(fe - 9, fe + 3), "max"),
        "dil_max_2": level(inside(fe - 2, fe + 3), "max"),
        "dil_max_3": level(inside(fe - 3, fe + 3), "mean"),
        "dil_flicker": level(fl, "mean"),
        "dil_max_30_t": F.min(F.when(fl & rise("top"), _t())) - F.first(fs),
        "dil_max_30_t_ext": F.min(F.when(ext & rise("top_ext"), _t())) - F.first(fs),
        "dil_mmd": F.median(F.when(near("at_max"), _y())),
        "dfc": value_from(fe),
        "con_max": level(rec, "min"),
        "con_max_t": F.first(F.col("at_min") - fs),
        "con_mmc": F.median(F.when(near("at_min"), _y())),
        "con_avg": level(inside(rs, rs + 40), "mean"),
        "auc": F.sum(trapezoid(fs, fe)),
        "auc_af": F.sum(trapezoid(rs + 50, rs + 80)),
        "auc_ef": F.sum(trapezoid(rs + 15, rs + 45)),
        "auc_dilation": F.sum(trapezoid(fs, fe, over)),
        "auc_constriction": F.sum(trapezoid(rs, re, under)),
        "t_auc_center": F.min(F.when((F.col("total") > 0) & F.col("step").isNotNull() & (F.col("cum") >= 0.5 * F.col("total")), F.col("pt") - fs)),
        "n_flicker": F.count_if(fl),
        "n_ext": F.count_if(ext),
        "n_recovery": F.count_if(rec),
        "n_baseline": F.count_if(base),
    }
    one = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    mx, mn = F.col("dil_max"), F.col("con_max")
    one = one.withColumns(
        {
            "baseline_fluct": F.col("baseline_max") - F.col("baseline_min"),
            "dil_max_bc": mx - bd,
            "dil_max_bc_ext": F.col("dil_max_ext") - bd,
            "dil_max_perc": percent_of(mx, bd),
            "dil_max_t_bc": F.when(bd.isNotNull(), F.col("dil_max_t")),
            "dil_max_t_bc_ext": F.when(bd.isNotNull(), F.col("dil_max_t_ext")),
            "dil_mmd_perc": percent_of(F.col("dil_mmd"), bd),
            "dil_slope": slope(mx - bd, F.col("dil_max_t")),
            "con_max_bc": mn - bd,
            "con_max_perc": -percent_of(mn, bd),
            "con_mmc_perc": -percent_of(F.col("con_mmc"), bd),
            "fic": percent_of(F.col("dfc"), bd),
            "da": mx - mn,
            "da_bc": (mx - bd) - (mn - bd),
            "da_bc_ext": (F.col("dil_max_ext") - bd) - (mn - bd),
            "da_perc": F.when(bd.isNotNull() & (bd != 0), (mx - mn) / bd * 100),
            "t_mdmc": F.col("con_max_t") - F.col("dil_max_t"),
        }
    )
    return one.withColumns({"bcfr": F.col("da") - F.col("baseline_fluct"), "con_slope": slope(mn - mx, F.col("t_mdmc"))})


@dataclass(frozen=True)
class Definition:
    """A parameter of a table: a column of ``biomarkers`` (or an expression over them) and the windows that it needs; or ``compute``, a function
    of the user's own from (y, t, cycle), a whole trace by time and a cycle, to a number."""

    key: str
    label: str
    units: str
    value: Callable[[], Column] | None = None
    needs: tuple[str, ...] = ()
    compute: Callable | None = None


def computed(key: str, compute: Callable, label: str = "", units: str = "signal") -> Definition:
    """A parameter by a function ``compute(y, t, cycle) -> float``. NaN and infinities are missing; what it raises is the row's error."""
    return Definition(key, label or key, units, compute=compute)


def _column(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


DEFAULT_SET = (
    Definition("max_dilation", "Maximal dilation", "signal", _column("dil_max"), ("n_flicker",)),
    Definition("max_constriction", "Maximal constriction", "signal", _column("con_max"), ("n_recovery",)),
    Definition("dilation_amplitude", "Dilation amplitude", "signal", _column("da"), ("n_flicker", "n_recovery")),
)
PAPER_SET = (
    Definition("max_dilation", "Maximal dilation", "signal", _column("dil_max_bc_ext"), ("n_ext", "n_baseline")),
    Definition("max_constriction", "Maximal constriction", "signal", _column("con_max_bc"), ("n_recovery", "n_baseline")),
    Definition("dilation_amplitude", "Dilation amplitude", "signal", _column("da_bc_ext"), ("n_ext", "n_recovery", "n_baseline")),
    Definition("time_to_max_dilation", "Time to maximal dilation", "s", _column("dil_max_t_bc_ext"), ("n_ext", "n_baseline")),
    Definition("time_to_max_constriction", "Time to maximal constriction", "s", _column("con_max_t"), ("n_recovery",)),
    Definition("t_mdmc", "Time between the extremes", "s", _column("t_mdmc"), ("n_flicker", "n_recovery")),
    Definition("time_to_max_dilation_30", "Time to 30 % of dilation", "s", _column("dil_max_30_t_ext"), ("n_ext", "n_baseline")),
    Definition("auc_dilation", "Area of dilation", "signal s", _column("auc_dilation"), ("n_flicker", "n_baseline")),
    Definition("auc_constriction", "Area of constriction", "signal s", _column("auc_constriction"), ("n_recovery", "n_baseline")),
)


def extract(traces: DataFrame, protocol: Protocol, definitions=PAPER_SET, keep_failed: bool = True) -> DataFrame:
    """Parameter table: ids, method, cycle_index, ok, error, error_stage and a column for each definition.

    A definition whose window has no sample is NULL and fails the row, as one whose function raises; the first one in order names the
    error. Windows with samples that are all missing give NULL and leave the row ok. Traces that have an ``error`` (and ``error_stage``) give
    failed rows with it. ``keep_failed`` False drops failed rows."""
    own = {d.key: d.compute for d in definitions if d.compute is not None}
    failed_before = "error" in traces.columns
    told = [F.max("error").alias("error_before"), F.max("error_stage").alias("stage_before")] if failed_before else []
    groups = traces.groupBy(*TRACE).agg(*told) if told else traces.select(*TRACE).distinct()
    every = groups.withColumn("cycle_index", F.explode(F.array(*[F.lit(c.index) for c in protocol.cycles])))
    good = traces.where(F.col("error").isNull()) if failed_before else traces
    wide = every.join(biomarkers(good, protocol), [*TRACE, "cycle_index"], "left")
    if own:
        wide = wide.join(plugins.parameters(good, protocol, own, TRACE), [*TRACE, "cycle_index"], "left")
    wide = wide.withColumns({n: F.coalesce(n, F.lit(0)) for n in sorted({n for d in definitions for n in d.needs})})
    fails = []
    for d in definitions:
        if d.compute is not None:
            fails.append((d, F.col(f"{d.key}__error").isNotNull(), F.col(f"{d.key}__error"), F.col(d.key)))
        else:
            empty = ~F.coalesce(*[F.when(F.col(n) == 0, F.lit(False)) for n in d.needs], F.lit(True))
            fails.append((d, empty, F.lit("ValueError: empty window"), d.value()))
    stage, error = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d, failed, message, _ in reversed(fails):
        stage = F.when(failed, f"compute:{d.key}").otherwise(stage)
        error = F.when(failed, message).otherwise(error)
    gone = F.lit(False)
    if failed_before:
        gone = F.col("error_before").isNotNull()
        stage, error = F.when(gone, F.col("stage_before")).otherwise(stage), F.when(gone, F.col("error_before")).otherwise(error)
    out = wide.select(*TRACE, "cycle_index", (stage.isNull() & ~gone).alias("ok"), error.alias("error"), stage.alias("error_stage"), *[F.when(~failed & ~gone, value).alias(d.key) for d, failed, _, value in fails])
    return out if keep_failed else out.where("ok")
