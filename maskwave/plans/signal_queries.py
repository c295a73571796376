"""Queries over cells and traces: protocol windows, aggregates, quality, biomarkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import biomarkers as B
from ..operators import quality as V
from ..operators import sequences as S
from ..sources.cells import CELLS_SQL
from .registry import IDS, SEG, TRACES_SQL, P, cells, over_cycles, query, rounded, traces

REST = P.global_baseline

# Protocol windows and masks.


@query("window_membership", CELLS_SQL + """, w(cycle_index, phase, s, e) AS (VALUES """ + ", ".join(f"({k}, '{w.phase}', {w.start}::DOUBLE, {w.end}::DOUBLE)" for k, w in P.windows()) + f""")
SELECT {IDS}, CAST(cycle_index AS INTEGER) AS cycle_index, phase, count(*) AS n, count(x) AS n_valid, round(1 - avg(m::INT), 6) AS missing
FROM cells JOIN w ON t >= s AND t < e GROUP BY ALL""")
def window_membership(spark, sf_dir):
    """Interval join of samples and protocol windows; the windows are a constant of a dozen rows."""
    w = F.broadcast(P.frame(spark).select("cycle_index", "phase", "start_sec", "end_sec"))  # one row a window of one protocol
    c = cells(spark, sf_dir)
    joined = c.join(w, (c["t"] >= w["start_sec"]) & (c["t"] < w["end_sec"]))
    out = joined.groupBy(*SEG, "cycle_index", "phase").agg(F.count("*").alias("n"), F.count("x").alias("n_valid"), (1 - F.avg(F.col("m").cast("int"))).alias("missing"))
    return rounded(out, "missing")


@query("phase_masks", CELLS_SQL + f"""
SELECT {IDS}, count(*) FILTER (t >= 50 AND t < 70 OR t >= 150 AND t < 170 OR t >= 250 AND t < 270) AS n_flicker,
  count(*) FILTER (t >= 120 AND t < 220) AS n_cycle1, count(*) FILTER (t_idx >= 0 AND t_idx < 20) AS n_rest_frames, round(avg(m::INT), 6) AS valid_fraction, max(t) < 320 AS ends_inside
FROM cells GROUP BY ALL""")
def phase_masks(spark, sf_dir):
    t = F.col("t")
    out = cells(spark, sf_dir).groupBy(*SEG).agg(
        F.count_if(P.in_phase(t, "flicker")).alias("n_flicker"),
        F.count_if(P.in_cycle(t, 1)).alias("n_cycle1"),
        F.count_if(REST.holds_frame(F.col("t_idx"), P.fs)).alias("n_rest_frames"),
        F.avg(F.col("m").cast("int")).alias("valid_fraction"),
        (F.max("t") < P.end()).alias("ends_inside"),
    )
    return rounded(out, "valid_fraction")


@query("slice_window", CELLS_SQL + f" SELECT {IDS}, vessel_type, t_idx, locus, x FROM cells WHERE t >= 50 AND t < 70 AND m AND segment_label IN ('A1', 'V3')")
def slice_window(spark, sf_dir):
    c = cells(spark, sf_dir).where(P.cycles[0].flicker.holds(F.col("t")) & F.col("m") & F.col("segment_label").isin("A1", "V3"))
    return c.select(*SEG, "vessel_type", "t_idx", "locus", "x")


@query("support_gate", CELLS_SQL + f""", n AS (SELECT {IDS}, t_idx, sum(m::INT) AS n_valid, count(*) AS n_loci, avg(x) AS y FROM cells GROUP BY ALL)
SELECT {IDS}, t_idx, CAST(n_valid AS BIGINT) AS n_valid, n_valid >= ceil(0.6 * n_loci) AS supported, round(CASE WHEN n_valid >= ceil(0.6 * n_loci) THEN y END, 6) AS y FROM n""")
def support_gate(spark, sf_dir):
    c = cells(spark, sf_dir)
    s = A.support(c, frac=0.6).join(A.aggregate_loci(c, "mean"), [*SEG, "t_idx"])
    return rounded(s.select(*SEG, "t_idx", "n_valid", "supported", F.when(F.col("supported"), F.col("y")).alias("y")), "y")


# Aggregates over loci and baselines.


@query("locus_median", TRACES_SQL + f" SELECT {IDS}, vessel_type, t_idx, t, y FROM tr")
def locus_median(spark, sf_dir):
    return A.aggregate_loci(cells(spark, sf_dir), "median")


@query("locus_mean", CELLS_SQL + f" SELECT {IDS}, t_idx, round(avg(x), 6) AS y FROM cells GROUP BY ALL")
def locus_mean(spark, sf_dir):
    return rounded(A.aggregate_loci(cells(spark, sf_dir), "mean").select(*SEG, "t_idx", "y"), "y")


@query("baseline_per_locus", CELLS_SQL + f" SELECT {IDS}, locus, median(x) AS base_median, max(x) AS base_max, min(x) AS base_min, round(avg(x), 6) AS base_mean FROM cells WHERE t >= 0 AND t < 20 GROUP BY ALL")
def baseline_per_locus(spark, sf_dir):
    c = cells(spark, sf_dir)
    parts = [A.baseline_per_locus(c, REST, s).withColumnRenamed("base", f"base_{s}") for s in ("median", "max", "min", "mean")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [*SEG, "locus"])
    return rounded(out, "base_mean")


@query("percent_aggregate_first", TRACES_SQL + f""", b AS (SELECT {IDS}, median(y) FILTER (t < 20) AS b FROM tr GROUP BY ALL)
SELECT {IDS}, t_idx, round(CASE WHEN b <> 0 THEN 100 * ((y - b) / b) END, 6) AS y FROM tr JOIN b USING ({IDS})""")
def percent_aggregate_first(spark, sf_dir):
    return rounded(A.percent_trace(cells(spark, sf_dir), REST).select(*SEG, "t_idx", "y"), "y")


@query("percent_locus_first", CELLS_SQL + f""", b AS (SELECT {IDS}, locus, median(x) FILTER (t < 20) AS b FROM cells GROUP BY ALL)
SELECT {IDS}, t_idx, round(median(CASE WHEN b <> 0 THEN 100 * ((x - b) / b) END), 6) AS y FROM cells JOIN b USING ({IDS}, locus) GROUP BY ALL""")
def percent_locus_first(spark, sf_dir):
    return rounded(A.percent_trace(cells(spark, sf_dir), REST, "percent_then_aggregate").select(*SEG, "t_idx", "y"), "y")


def _scale_sql(by: str) -> str:
    return CELLS_SQL + f""", r AS (SELECT {IDS}, locus, x - median(x) OVER (PARTITION BY {IDS}, locus) AS r, median(x) OVER (PARTITION BY {IDS}, locus) AS mu FROM cells WHERE t < 20 AND x IS NOT NULL),
q AS (SELECT *, median(r) OVER (PARTITION BY {by}) AS mid FROM r),
s AS (SELECT {by}, 1.4826::DOUBLE * median(abs(r - mid)) AS mad, stddev_pop(r) AS sd0 FROM q GROUP BY ALL),
l AS (SELECT DISTINCT {IDS}, locus FROM cells), u AS (SELECT {IDS}, locus, first(mu) AS mu FROM r GROUP BY ALL)
SELECT {IDS}, locus, mu, round(greatest(CASE WHEN mad > 0 THEN mad WHEN sd0 > 0 THEN sd0 ELSE 1 END, 1e-6::DOUBLE), 6) AS sd FROM l LEFT JOIN u USING ({IDS}, locus) LEFT JOIN s USING ({by})"""


@query("scale_global", _scale_sql(IDS))
def scale_global(spark, sf_dir):
    return rounded(A.center_and_scale(cells(spark, sf_dir), REST), "sd")


@query("scale_per_locus", _scale_sql(f"{IDS}, locus"))
def scale_per_locus(spark, sf_dir):
    return rounded(A.center_and_scale(cells(spark, sf_dir), REST, "per_locus"), "sd")


@query("locus_band", CELLS_SQL + f" SELECT {IDS}, t_idx, round(quantile_cont(x, 0.25), 6) AS q_low, median(x) AS med, round(quantile_cont(x, 0.75), 6) AS q_high FROM cells GROUP BY ALL")
def locus_band(spark, sf_dir):
    return rounded(A.locus_band(cells(spark, sf_dir)), "q_low", "q_high")


@query("sampling_interval", TRACES_SQL + f" SELECT {IDS}, median(d) AS dt FROM (SELECT {IDS}, t - lag(t) OVER (PARTITION BY {IDS} ORDER BY t_idx) AS d FROM tr) GROUP BY ALL")
def sampling_interval(spark, sf_dir):
    return A.sampling_interval(traces(spark, sf_dir))


@query("energy_ratio", CELLS_SQL + f""", d AS (SELECT *, median(x) OVER (PARTITION BY {IDS}, t_idx) AS s FROM cells)
SELECT {IDS}, CAST(floor((t - 20) / 100) AS INTEGER) AS cycle_index, round(sqrt(sum((x - s) ** 2)) / (sqrt(sum(s ** 2)) + 1e-8), 6) AS ratio, count(*) AS n_obs
FROM d WHERE m AND t >= 20 AND t < 320 GROUP BY ALL""")
def energy_ratio(spark, sf_dir):
    """Energy of what the median over loci leaves, against the median, in each cycle."""
    from pyspark.sql import Window as W

    c = cells(spark, sf_dir).where("t >= 20 and t < 320")
    c = c.withColumn("s", F.median("x").over(W.partitionBy(*SEG, "t_idx"))).withColumn("a", F.col("x") - F.col("s"))
    c = c.withColumn("cycle_index", F.floor((F.col("t") - 20) / 100).cast("int"))
    return rounded(A.energy_ratio(c, [*SEG, "cycle_index"]), "ratio")


# Quality.

_MISSING = {("missing_global_baseline" if k < 0 else f"missing_cycle{k}_{w.phase}"): w for k, w in P.windows()}
_QUALITY_SQL = CELLS_SQL + f""", size AS (SELECT {IDS}, vessel_type, count(DISTINCT locus) AS n_loci, count(DISTINCT t_idx) AS n_times, round(1 - avg(m::INT), 6) AS missing_total,
  {", ".join(f"1 - avg(m::INT) FILTER (t >= {w.start} AND t < {w.end}) AS {n}" for n, w in _MISSING.items())} FROM cells GROUP BY ALL),
fr AS (SELECT {IDS}, t_idx, bool_or(m) AS ok FROM cells GROUP BY ALL),
isl AS (SELECT {IDS}, t_idx - row_number() OVER (PARTITION BY {IDS} ORDER BY t_idx) AS g FROM fr WHERE NOT ok),
gaps AS (SELECT {IDS}, count(*) AS n FROM isl GROUP BY {IDS}, g),
gc AS (SELECT {IDS}, count(*) FILTER (n >= 5 AND n < 10) AS gaps_small, count(*) FILTER (n >= 10 AND n < 25) AS gaps_medium, count(*) FILTER (n >= 25) AS gaps_large FROM gaps GROUP BY ALL),
noise AS (SELECT {IDS}, avg(y) AS bm, stddev_pop(y) AS bs FROM (SELECT {IDS}, t_idx, avg(x) AS y FROM cells WHERE t_idx < 20 GROUP BY ALL) GROUP BY ALL),
j AS (SELECT *, (missing_cycle0_flicker + missing_cycle1_flicker + missing_cycle2_flicker) / 3 AS mf FROM size LEFT JOIN gc USING ({IDS}) LEFT JOIN noise USING ({IDS}))
"""


@query("quality_report", _QUALITY_SQL + f"""SELECT {IDS}, vessel_type, n_loci, n_times, missing_total, {", ".join(f"round({n}, 6) AS {n}" for n in _MISSING)}, round(mf, 6) AS missing_flicker,
  coalesce(gaps_small, 0) AS gaps_small, coalesce(gaps_medium, 0) AS gaps_medium, coalesce(gaps_large, 0) AS gaps_large, round(bm, 6) AS baseline_mean, round(bs, 6) AS baseline_std,
  round(CASE WHEN bs > 0 THEN 20 * log10(abs(bm) / bs) END, 6) AS baseline_snr_db, n_loci < 3 AS flag_too_few_loci, missing_total > 0.5 AS flag_missing_total, mf > 0.67 AS flag_missing_flicker,
  coalesce(gaps_large, 0) > 0 AS flag_large_gaps, NOT (n_loci < 3 OR missing_total > 0.5 OR mf > 0.67 OR coalesce(gaps_large, 0) > 0) AS passed FROM j""")
def quality_report(spark, sf_dir):
    out = V.report(cells(spark, sf_dir), P, V.Thresholds(min_loci=3)).drop("gaps")
    return rounded(out, "missing_total", *_MISSING, "missing_flicker", "baseline_mean", "baseline_std", "baseline_snr_db")


@query("quality_by_recording", _QUALITY_SQL + """SELECT subject_id, visit_id, count(*) AS n_segments, count(*) FILTER (NOT (n_loci < 3 OR missing_total > 0.5 OR mf > 0.67 OR coalesce(gaps_large, 0) > 0)) AS n_passed,
  count(*) FILTER (n_loci < 3) AS n_too_few_loci, round(avg(CASE WHEN n_loci >= 3 THEN missing_total END), 5) AS missing_mean, round(max(CASE WHEN n_loci >= 3 THEN missing_total END), 5) AS missing_max FROM j GROUP BY ALL""")
def quality_by_recording(spark, sf_dir):
    report = rounded(V.report(cells(spark, sf_dir), P, V.Thresholds(min_loci=3)), "missing_total")
    return rounded(V.by_recording(report), "missing_mean", "missing_max", digits=5)


@query("quality_defaults", CELLS_SQL + f" SELECT {IDS}, count(DISTINCT locus) AS n_loci, TRUE AS flag_too_few_loci, CAST(NULL AS DOUBLE) AS missing_total, FALSE AS passed FROM cells GROUP BY ALL")
def quality_defaults(spark, sf_dir):
    """The default least number of loci, which five loci don't reach: size and flag only."""
    return V.report(cells(spark, sf_dir), P).select(*SEG, "n_loci", "flag_too_few_loci", "missing_total", "passed")


_RUNS = CELLS_SQL + f""", fr AS (SELECT {IDS}, t_idx, bool_or(m) AS ok FROM cells GROUP BY ALL),
isl AS (SELECT {IDS}, t_idx, t_idx - row_number() OVER (PARTITION BY {IDS} ORDER BY t_idx) AS g FROM fr WHERE NOT ok),
r AS (SELECT {IDS}, min(t_idx) AS "start", max(t_idx) AS "end", CAST(count(*) AS INTEGER) AS length FROM isl GROUP BY {IDS}, g)
"""


@query("gap_islands", _RUNS + f"""SELECT {IDS}, "start", "end", length, CASE WHEN length >= 3 THEN 'large' WHEN length >= 2 THEN 'medium' ELSE 'small' END AS kind FROM r""")
def gap_islands(spark, sf_dir):
    return V.gap_runs(cells(spark, sf_dir), V.Thresholds(small=1, medium=2, large=3))


@query("longest_gap", _RUNS + f"""SELECT {IDS}, "start", "end", length FROM r QUALIFY row_number() OVER (PARTITION BY {IDS} ORDER BY length DESC, "start") = 1""")
def longest_gap(spark, sf_dir):
    frames = cells(spark, sf_dir).groupBy(*SEG, "t_idx").agg(F.max("m").alias("ok"))
    return S.longest_run(frames, ~F.col("ok"), SEG)


# Biomarkers.

_IN = lambda a, b: f"(t >= {a} AND t < {b})"
_ONE = f"""SELECT {IDS}, {{k}} AS cycle_index, avg(y) FILTER {_IN("{fs} - 20", "{fs}")} AS baseline_dynamic, median(y) FILTER {_IN("{bs}", "{be}")} AS bd,
  max(y) FILTER {_IN("{bs}", "{be}")} AS baseline_max, min(y) FILTER {_IN("{bs}", "{be}")} AS baseline_min, max(y) FILTER {_IN("{fs}", "{fe}")} AS dil_max,
  max(y) FILTER {_IN("{fs}", "{fe} + 10")} AS dil_max_ext,
  arg_max(t, (y, -t)) FILTER (t >= {{fs}} AND t < {{fe}} AND y IS NOT NULL) - {{fs}} AS dil_max_t, arg_max(t, (y, -t)) FILTER (t >= {{fs}} AND t < {{fe}} + 10 AND y IS NOT NULL) - {{fs}} AS dil_max_t_ext,
  max(y) FILTER {_IN("{fe} - 9", "{fe} + 3")} AS dil_max_1, max(y) FILTER {_IN("{fe} - 2", "{fe} + 3")} AS dil_max_2, avg(y) FILTER {_IN("{fe} - 3", "{fe} + 3")} AS dil_max_3,
  avg(y) FILTER {_IN("{fs}", "{fe}")} AS dil_flicker, first(y ORDER BY t_idx) FILTER (t >= {{fe}}) AS dfc, min(y) FILTER {_IN("{rs}", "{re}")} AS con_max,
  arg_min(t, (y, t)) FILTER (t >= {{rs}} AND t < {{re}} AND y IS NOT NULL) - {{fs}} AS con_max_t, avg(y) FILTER {_IN("{rs}", "{rs} + 40")} AS con_avg FROM tr GROUP BY ALL"""
_TWO = f"""SELECT {IDS}, {{k}} AS cycle_index, min(t) FILTER (t >= {{fs}} AND t < {{fe}} AND y >= bd + 0.3::DOUBLE * (dil_max - bd)) - {{fs}} AS dil_max_30_t,
  min(t) FILTER (t >= {{fs}} AND t < {{fe}} + 10 AND y >= bd + 0.3::DOUBLE * (dil_max_ext - bd)) - {{fs}} AS dil_max_30_t_ext,
  median(y) FILTER (t >= dil_max_t + {{fs}} - 2 AND t < dil_max_t + {{fs}} + 2) AS dil_mmd, median(y) FILTER (t >= con_max_t + {{fs}} - 2 AND t < con_max_t + {{fs}} + 2) AS con_mmc
  FROM tr JOIN one USING ({IDS}) WHERE cycle_index = {{k}} GROUP BY ALL"""


def _area_sql(name: str, a: str, b: str, v: str = "y") -> str:
    inner = f"SELECT {IDS}, t, {v} AS v FROM tr JOIN one USING ({IDS}) WHERE cycle_index = {{k}} AND t >= {a} AND t < {b} AND {v} IS NOT NULL"
    return f"SELECT {IDS}, {{k}} AS cycle_index, sum((t - pt) * (v + pv) / 2) AS {name} FROM (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM ({inner}) WINDOW w AS (PARTITION BY {IDS} ORDER BY t)) GROUP BY ALL"


_OVER, _UNDER = "CASE WHEN y IS NOT NULL AND bd IS NOT NULL THEN greatest(y - bd, 0) END", "CASE WHEN y IS NOT NULL AND bd IS NOT NULL THEN greatest(bd - y, 0) END"
_CENTER = f"""SELECT {IDS}, {{k}} AS cycle_index, min(t) FILTER (tot > 0 AND cum >= 0.5::DOUBLE * tot) - {{fs}} AS t_auc_center FROM (
  SELECT {IDS}, t, sum(step) OVER (PARTITION BY {IDS} ORDER BY t ROWS UNBOUNDED PRECEDING) AS cum, sum(step) OVER (PARTITION BY {IDS}) AS tot FROM (
    SELECT {IDS}, t, (lead(t) OVER w - t) * (lead(v) OVER w + v) / 2 AS step FROM (SELECT {IDS}, t, {_OVER} AS v FROM tr JOIN one USING ({IDS})
      WHERE cycle_index = {{k}} AND t >= {{fs}} AND t < {{re}} AND {_OVER} IS NOT NULL) WINDOW w AS (PARTITION BY {IDS} ORDER BY t)) WHERE step IS NOT NULL) GROUP BY ALL"""
_AREAS = {"auc": ("{fs}", "{fe}", "y"), "auc_af": ("{rs} + 50", "{rs} + 80", "y"), "auc_ef": ("{rs} + 15", "{rs} + 45", "y"), "auc_dilation": ("{fs}", "{fe}", _OVER), "auc_constriction": ("{rs}", "{re}", _UNDER)}
_PCT = lambda v: f"CASE WHEN bd <> 0 THEN ({v} - bd) / bd * 100 END"
BIOMARKER_SQL = (
    TRACES_SQL
    + ", one AS ("
    + over_cycles(_ONE)
    + "), two AS ("
    + over_cycles(_TWO)
    + "), "
    + ", ".join(f"{n} AS ({over_cycles(_area_sql(n, *v))})" for n, v in _AREAS.items())
    + ", cen AS ("
    + over_cycles(_CENTER)
    + f"""), al AS (SELECT * FROM one LEFT JOIN two USING ({IDS}, cycle_index) """
    + " ".join(f"LEFT JOIN {n} USING ({IDS}, cycle_index)" for n in [*_AREAS, "cen"])
    + ")\n"
)
_RAW = ("bd", "baseline_max", "baseline_min", "dil_max", "dil_max_ext", "dil_max_t", "dil_max_t_ext", "dil_max_1", "dil_max_2", "dfc", "con_max", "con_max_t", "dil_max_30_t", "dil_max_30_t_ext", "dil_mmd", "con_mmc", "t_auc_center")
_MADE = {
    "baseline_dynamic": "baseline_dynamic", "dil_max_3": "dil_max_3", "dil_flicker": "dil_flicker", "con_avg": "con_avg", "baseline_fluct": "baseline_max - baseline_min",
    "dil_max_bc": "dil_max - bd", "dil_max_perc": _PCT("dil_max"), "dil_slope": "CASE WHEN dil_max_t > 0 THEN (dil_max - bd) / dil_max_t END", "con_max_bc": "con_max - bd",
    "con_max_perc": f"-({_PCT('con_max')})", "fic": _PCT("dfc"), "da": "dil_max - con_max", "da_bc": "(dil_max - bd) - (con_max - bd)", "da_perc": "CASE WHEN bd <> 0 THEN (dil_max - con_max) / bd * 100 END",
    "bcfr": "dil_max - con_max - (baseline_max - baseline_min)", "t_mdmc": "con_max_t - dil_max_t", "con_slope": "CASE WHEN con_max_t - dil_max_t > 0 THEN (con_max - dil_max) / (con_max_t - dil_max_t) END",
    "dil_mmd_perc": _PCT("dil_mmd"), "con_mmc_perc": f"-({_PCT('con_mmc')})", **{n: n for n in _AREAS},
}


@query("biomarkers", BIOMARKER_SQL + f"SELECT {IDS}, cycle_index, {', '.join(_RAW)}, {', '.join(f'round({v}, 6) AS {n}' for n, v in _MADE.items())} FROM al")
def biomarkers(spark, sf_dir):
    out = B.biomarkers(traces(spark, sf_dir), P)
    return rounded(out.select(*SEG, "cycle_index", *_RAW, *_MADE), *_MADE)


@query("parameters_paper", BIOMARKER_SQL + f"""SELECT {IDS}, 'raw' AS method, cycle_index, TRUE AS ok, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS error_stage,
  round(dil_max_ext - bd, 6) AS max_dilation, round(con_max - bd, 6) AS max_constriction, round((dil_max_ext - bd) - (con_max - bd), 6) AS dilation_amplitude, CASE WHEN bd IS NOT NULL THEN dil_max_t_ext END AS time_to_max_dilation,
  con_max_t AS time_to_max_constriction, con_max_t - dil_max_t AS t_mdmc, dil_max_30_t_ext AS time_to_max_dilation_30, round(auc_dilation, 6) AS auc_dilation, round(auc_constriction, 6) AS auc_constriction FROM al""")
def parameters_paper(spark, sf_dir):
    out = B.extract(traces(spark, sf_dir), P).drop("vessel_type")
    return rounded(out, "max_dilation", "max_constriction", "dilation_amplitude", "auc_dilation", "auc_constriction")


@query("parameters_default", BIOMARKER_SQL + f"SELECT {IDS}, cycle_index, TRUE AS ok, dil_max AS max_dilation, con_max AS max_constriction, round(dil_max - con_max, 6) AS dilation_amplitude FROM al")
def parameters_default(spark, sf_dir):
    out = B.extract(traces(spark, sf_dir), P, B.DEFAULT_SET)
    return rounded(out.select(*SEG, "cycle_index", "ok", "max_dilation", "max_constriction", "dilation_amplitude"), "dilation_amplitude")


@query("parameters_short_recording", TRACES_SQL + f"""SELECT DISTINCT {IDS}, k AS cycle_index, k < 1 AS ok, CASE WHEN k >= 1 THEN 'ValueError: empty window' END AS error, CASE WHEN k >= 1 THEN 'compute:max_dilation' END AS error_stage FROM tr, (VALUES (0), (1), (2)) v(k)""")
def parameters_short_recording(spark, sf_dir):
    """A recording that stops before the second flicker: its later cycles fail and are kept as failed rows."""
    return B.extract(traces(spark, sf_dir).where("t < 150"), P, B.DEFAULT_SET).select(*SEG, "cycle_index", "ok", "error", "error_stage")
