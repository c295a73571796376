"""Preprocessors by name, the run from a folder to a parameter table, and the evaluation of denoisers on hybrids with known truth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.protocol import Protocol
from ..sources import reader
from ..sources.cells import KEY
from ..sources.shared import written
from . import aggregates as A
from . import biomarkers as B
from . import denoise as N
from . import hybrid as H
from . import metrics as M
from . import sequences as S
from . import smoothing as D

#: A preprocessor takes cells, a protocol and its options and gives traces (KEY, vessel_type, t_idx, t, y).
Preprocessor = Callable[..., DataFrame]
_KNOWN: dict[str, Preprocessor] = {}


def register(name: str, run: Preprocessor) -> None:
    """Makes a preprocessor of the user's known by a name; a known name is replaced. ``plugins.segments`` and ``plugins.recordings`` make one of a
    function over arrays. A preprocessor may add ``error``, which rows of segments that it could not do have."""
    _KNOWN[name] = run


register("rpca", lambda cells, protocol, **options: N.rpca_trace(cells, protocol, N.RpcaConfig(**options)))
register("group_rpca", lambda cells, protocol, **options: N.group_rpca_trace(cells, protocol, **options))
register("kotliar", lambda cells, protocol, **options: D.kotliar_template(A.aggregate_loci(cells), protocol, **options))
register("gherghel", lambda cells, protocol, **options: D.polynomial(A.aggregate_loci(cells), protocol, **options))
register("sms", lambda cells, protocol, **options: D.sms(A.aggregate_loci(cells), protocol, **options))
register("sms_avg", lambda cells, protocol, **options: D.sms_average(A.aggregate_loci(cells), protocol, **options))
register("raw", lambda cells, protocol: S.percent_of_window(A.aggregate_loci(cells), protocol.reference(), D.BY))


def preprocess(cells: DataFrame, protocol: Protocol, name: str = "rpca", **options) -> DataFrame:
    """Traces of a named preprocessor, with its name as ``method``. A segment that it could not do, or whose cells have an ``error`` (of its
    file), is one row with ``error`` and ``error_stage`` and without times; all others have their traces."""
    if name not in _KNOWN:
        raise ValueError(f"unknown preprocessor {name}; known: {', '.join(sorted(_KNOWN))}")
    ids, nothing = [*KEY, "vessel_type"], F.lit(None)
    unread = None
    if "error" in cells.columns:
        unread = cells.where(F.col("error").isNotNull()).groupBy(*ids).agg(F.max("error").alias("error"))
        unread = unread.select(*ids, nothing.cast("int").alias("t_idx"), nothing.cast("double").alias("t"), nothing.cast("double").alias("y"), "error", F.lit("read").alias("error_stage"))
        cells = cells.where(F.col("error").isNull()).drop("error")
    traces = _KNOWN[name](cells, protocol, **options)
    error = F.col("error") if "error" in traces.columns else nothing.cast("string")
    traces = traces.select(*ids, "t_idx", "t", "y", error.alias("error"), F.when(error.isNotNull(), F.lit(f"preprocess:{name}")).alias("error_stage"))
    return (traces if unread is None else traces.unionByName(unread)).withColumn("method", F.lit(name))


def as_cells(traces: DataFrame) -> DataFrame:
    """A result seen as a signal of one locus, observed where it has a value."""
    return traces.select(*KEY, "vessel_type", "t_idx", "t", F.lit(0).alias("locus"), F.col("y").alias("x"), F.col("y").isNotNull().alias("m"))


def parameters(cells: DataFrame, protocol: Protocol, methods: tuple[str, ...] = ("rpca",), definitions=B.PAPER_SET, options: dict[str, dict] | None = None, keep_failed: bool = True) -> DataFrame:
    """One parameter table of several preprocessors: a row for each segment, method and cycle."""
    tables = [B.extract(preprocess(cells, protocol, m, **(options or {}).get(m, {})), protocol, definitions, keep_failed) for m in methods]
    return reduce(DataFrame.unionByName, tables)


def run(spark: SparkSession, folder: str, protocol: Protocol, preprocessor: str = "rpca", definitions=B.PAPER_SET, included: DataFrame | None = None, settings: reader.Settings = reader.Settings(), **options) -> dict[str, DataFrame]:
    """From a folder of exports to cells, traces and parameters; nothing runs before one of them is asked for."""
    if protocol is None:
        raise ValueError("a protocol is needed to read and to cut recordings")
    cells = reader.keep_included(reader.read(spark, folder, protocol, settings=settings), included)
    traces = preprocess(cells, protocol, preprocessor, **options)
    return {"cells": cells, "traces": traces, "parameters": B.extract(traces, protocol, definitions)}


def average_truth(truth: DataFrame, protocol: Protocol) -> DataFrame:
    """The median over cycles of a known trace, at each cycle's place (columns KEY, vessel_type, t_idx, t, y)."""
    stacked = S.stack_cycles(truth, protocol, D.BY)
    return S.tile(S.cycle_template(stacked, D.BY), stacked, truth, D.BY)


#: Method of an evaluation: its preprocessor, and whether its truth is averaged over cycles.
METHODS = {"rpca": ("rpca", False), "rpca_gamma0": ("rpca", False), "sms": ("sms", False), "sms_avg": ("sms_avg", False), "sms_avg_fair": ("sms_avg", True)}


def evaluate(hybrid: DataFrame, protocol: Protocol, methods=tuple(METHODS), support: float = 0.75, config: N.RpcaConfig = N.RpcaConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """sdr, nmse, delta_sdr, instability of the plateau and biases of biomarkers for each segment, configuration and method of hybrids.

    Frames in which fewer than ``support`` of the loci are observed count for none of the distances. Biases are columns
    ``bias_<biomarker>_c<cycle>``. ``by``: further columns of the hybrid (levels of a sweep) that stay beside the rows.

    ``sdr_c<cycle>`` is the sdr over the frames of one cycle alone. The hybrid, its frames and the recovered traces are tables in the shared folder, so
    each later step is a plan of its own and starts from them when an executor is lost. A segment that a method could not do has NULLs."""
    ids = ["config", *by]
    tag = F.to_json(F.struct("visit_id", *ids))  # a visit of its own for each configuration and level, whatever is NULL
    cells = written(hybrid.withColumns({"whole_visit": F.col("visit_id"), "visit_id": tag}), "hybrid")
    names = cells.select(*D.BY, "whole_visit", *ids).distinct()
    raw = F.median(F.when(F.col("m"), F.col("x"))).alias("y")
    frames = cells.groupBy(*D.BY, "t_idx", "t").agg(F.first("truth").alias("truth"), (F.avg(F.col("m").cast("int")) >= support).alias("held"), raw)
    frames = written(frames, "frames")
    traces = frames.select(*D.BY, "t_idx", "t", "y")
    smoothed = {"sms": D.sms, "sms_avg": D.sms_average}
    found = []
    for name in methods:
        how, _ = METHODS[name]
        if how in smoothed:
            part = smoothed[how](traces, protocol).withColumn("method", F.lit(name))
        else:
            knobs = replace(config, gamma=0.0) if name == "rpca_gamma0" else config
            options = {f: getattr(knobs, f) for f in knobs.__dataclass_fields__} if how == "rpca" else {}
            part = preprocess(cells.drop("whole_visit", "truth", *ids), protocol, how, **options).where("error is null").withColumn("method", F.lit(name))
        found.append(part.select(*D.BY, "t_idx", "t", "y", "method"))
    found = written(reduce(DataFrame.unionByName, found), "found")
    fair = [m for m in methods if METHODS[m][1]]
    truth = frames.select(*D.BY, "t_idx", "t", F.col("truth").alias("y"))
    kinds, known = F.when(F.col("method").isin(*fair), "fair").otherwise("own") if fair else F.lit("own"), truth.withColumn("method", F.lit("own"))
    sides = S.percent_of_window(frames, protocol.reference(), D.BY).withColumnRenamed("y", "corrupt").where("held").drop("t")
    if fair:
        averaged = written(average_truth(truth, protocol).select(*D.BY, "t_idx", "t", "y"), "fair")
        known = known.unionByName(averaged.withColumn("method", F.lit("fair")))
        sides = sides.join(averaged.select(*KEY, "t_idx", F.col("y").alias("fair")), [*KEY, "t_idx"], "left")
    keys = [*KEY, "method"]
    pairs = found.select(*keys, "t_idx", "t", F.col("y").alias("found")).join(sides.drop("vessel_type"), [*KEY, "t_idx"])
    pairs = pairs.withColumn("truth", F.when(kinds == "fair", F.col("fair")).otherwise(F.col("truth")) if fair else F.col("truth"))
    cycles = {f"sdr_c{c.index}": protocol.in_cycle(F.col("t"), c.index) for c in protocol.cycles}
    out = M.fidelity(pairs, keys, support=0.0, within=cycles).drop("support")
    bias = M.bias_of_kinds(known, found, protocol, kinds)
    wide = bias.withColumn("name", F.concat_ws("_", F.lit("bias"), "biomarker", F.concat(F.lit("c"), "cycle_index")))
    columns = [f"bias_{n}_c{c.index}" for c in protocol.cycles for n in M.BIASES]
    still = (F.col("biomarker") == "tMAD") & F.col("bias").isNotNull()
    moved = F.avg(F.when(still, (F.abs("bias") > 0.5).cast("int"))).alias("instability")
    wide = wide.groupBy(*keys).agg(moved, *[F.first(F.when(F.col("name") == n, F.col("bias")), ignorenulls=True).alias(n) for n in columns])
    rows = names.withColumn("method", F.explode(F.array(*map(F.lit, methods)))).join(out, keys, "left").join(wide, keys, "left")
    return rows.withColumn("visit_id", F.col("whole_visit")).drop("whole_visit", "vessel_type")


def numbered(df: DataFrame, by: list[str], name: str, parts: int = 64) -> tuple[DataFrame, int]:
    """Rows numbered from 1, in an order by hash: each part by itself, after the parts before it. Only the parts' counts come to the driver."""
    dealt = df.withColumns({"hash": F.xxhash64(*by)}).withColumn("part", F.pmod("hash", F.lit(parts)).cast("int"))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    before = {p: sum(n for q, n in counts.items() if q < p) for p in counts}
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part")) if before else F.lit(0)
    out = dealt.withColumn(name, (offset + F.row_number().over(W.partitionBy("part").orderBy("hash", *by))).cast("int")).drop("hash", "part")
    return out, sum(counts.values())


def non_stationary(triplets: DataFrame, cells: DataFrame, protocol: Protocol, n_configs: int = 1, seed: int = 0) -> DataFrame:
    """Hybrids whose cycles are scaled by a measured triplet (m0, m1, m2), drawn by hash for every segment; other columns as of ``build``."""
    rows, n = numbered(triplets.select("m0", "m1", "m2"), ["m0", "m1", "m2"], "triplet")
    draw = H.uniform(seed, "triplet", *[F.col(k) for k in KEY])
    drawn = cells.select(*KEY).distinct().withColumn("triplet", (F.floor(draw * n) + 1).cast("int"))
    return H.build(cells, protocol, n_configs, seed, factors=drawn.join(rows, "triplet"))


def grid_search(hybrid: DataFrame, protocol: Protocol, lams: tuple[float, ...], gammas: tuple[float, ...], config: N.RpcaConfig = N.RpcaConfig(), support: float = 0.75) -> DataFrame:
    """Mean and median sdr of the decomposition over hybrids, for every lam and gamma, and the number of hybrids: levels are columns, and a
    segment's matrix with each pair of them is a group of its own."""
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("lam"), F.lit(float(y)).alias("gamma")) for x in lams for y in gammas])
    tagged = hybrid.withColumn("g", F.explode(pairs)).select("*", "g.lam", "g.gamma").drop("g")
    tagged = written(tagged.withColumn("visit_id", F.to_json(F.struct("visit_id", "config", "lam", "gamma"))), "grid")
    truth = tagged.groupBy(*KEY, "t_idx").agg(F.first("lam").alias("lam"), F.first("gamma").alias("gamma"), F.first("truth").alias("truth"), (F.avg(F.col("m").cast("int")) >= support).alias("held"))
    found = N.rpca_trace(tagged.drop("truth", "config"), protocol, config).select(*KEY, "t_idx", F.col("y").alias("found"))
    each = truth.where("held").join(found, [*KEY, "t_idx"], "left").groupBy(*KEY, "lam", "gamma").agg(M.sdr(F.col("truth"), F.col("found"), least=10).alias("sdr"))
    return each.groupBy("lam", "gamma").agg(F.avg("sdr").alias("mean_sdr"), F.median("sdr").alias("median_sdr"), F.count("sdr").alias("n"))
