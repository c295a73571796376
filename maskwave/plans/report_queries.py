"""Queries of reports: what plots are drawn from, comparisons of a study, and long running medians."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparisons as C
from ..operators import denoise as N
from ..operators import plotdata as D
from ..operators import quality as V
from ..operators import sequences as S
from ..sources.cells import CELLS_SQL, is_artery, is_vein
from .registry import IDS, SEG, TRACES_SQL, P, cells, load, query, rounded, traces

_PIXELS = 40
_PIX = f"CAST(least(floor(t / {P.end()} * {_PIXELS}), {_PIXELS - 1}) AS INTEGER)"


@query(
    "line_points",
    TRACES_SQL
    + f""", s AS (SELECT {IDS}, t, y, {_PIX} AS pixel FROM tr WHERE y IS NOT NULL AND t >= 0 AND t < {P.end()}),
a AS (SELECT {IDS}, pixel, [min_by({{'t': t, 'y': y}}, t), max_by({{'t': t, 'y': y}}, t), min_by({{'t': t, 'y': y}}, {{'y': y, 't': t}}), max_by({{'t': t, 'y': y}}, {{'y': y, 't': -t}})] AS ps FROM s GROUP BY ALL)
SELECT {IDS}, pixel, p.t AS t, p.y AS y FROM (SELECT {IDS}, pixel, unnest(list_distinct(ps)) AS p FROM a)""",
)
def line_points(spark, sf_dir):
    """Traces as 40 pixels' first, last, lowest and highest points."""
    return D.line(traces(spark, sf_dir), SEG, 0.0, P.end(), _PIXELS)


@query(
    "surface_tiles",
    TRACES_SQL
    + f""", q AS (SELECT {IDS}, quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM cells WHERE x IS NOT NULL AND t < {P.end()} GROUP BY ALL)
SELECT {IDS}, CAST(locus + 1 AS INTEGER) AS "row", {_PIX} AS pixel, min(x) AS low, max(x) AS high, count(x) AS n, round(any_value(a - 0.05 * (b - a)), 6) AS range_low, round(any_value(b + 0.05 * (b - a)), 6) AS range_high
FROM cells LEFT JOIN q USING ({IDS}) WHERE t >= 0 AND t < {P.end()} GROUP BY {IDS}, locus, pixel""",
)
def surface_tiles(spark, sf_dir):
    """Loci over time as tiles of 40 pixels, with the colour range."""
    return rounded(D.surface(cells(spark, sf_dir), 0.0, P.end(), _PIXELS), "range_low", "range_high")


_SMOOTH = "median(y) OVER (PARTITION BY subject_id, visit_id, segment_label ORDER BY t_idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(
    "triage_points",
    TRACES_SQL
    + f""", b AS (SELECT {IDS}, 'raw' AS series, t, y FROM tr UNION ALL SELECT {IDS}, 'smooth', t, {_SMOOTH.format(4)} FROM tr),
s AS (SELECT *, CAST(least(floor((t - 20) / 100 * 25), 24) AS INTEGER) AS pixel FROM b WHERE y IS NOT NULL AND t >= 20 AND t < 120),
a AS (SELECT {IDS}, series, pixel, [min_by({{'t': t, 'y': y}}, t), max_by({{'t': t, 'y': y}}, t), min_by({{'t': t, 'y': y}}, {{'y': y, 't': t}}), max_by({{'t': t, 'y': y}}, {{'y': y, 't': -t}})] AS ps FROM s GROUP BY ALL)
SELECT {IDS}, series, pixel, p.t AS t, p.y AS y FROM (SELECT {IDS}, series, pixel, unnest(list_distinct(ps)) AS p FROM a)""",
)
def triage_points(spark, sf_dir):
    """One cycle of each segment as its median over loci and a running median of five samples, in 25 pixels."""
    return D.triage(cells(spark, sf_dir), P, 5.0, 20.0, 120.0, 25)


@query("running_median_long", TRACES_SQL + f" SELECT {IDS}, t_idx, {_SMOOTH.format(60)} AS y FROM tr")
def running_median_long(spark, sf_dir):
    """A frame of 61 samples, by the sorted window."""
    return S.causal_median(traces(spark, sf_dir).select(*SEG, "t_idx", "y"), SEG, 61)


# Line items as a study: what two shipments of a supplier have in common stands for a sample that several methods worked on.
_STUDY = """study AS (SELECT CASE l_linestatus WHEN 'O' THEN 'stationary' ELSE 'non_stationary' END AS condition, CASE WHEN l_orderkey % 2 = 0 THEN 'artery' ELSE 'vein' END AS vessel_type,
  l_suppkey AS cluster, l_linenumber AS config, CASE l_returnflag WHEN 'A' THEN 'rpca' WHEN 'N' THEN 'sms_avg' ELSE 'sms' END AS method, l_partkey, l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
v AS (SELECT condition, vessel_type, cluster, config, method, max(l_partkey % 101) AS sdr, max(l_orderkey % 37) AS nmse, max(l_partkey % 23) - 11 AS md, max(q % 13) - 6 AS mc FROM study GROUP BY ALL),
long AS (SELECT condition, vessel_type, cluster, config, method, unnest([{'metric': 'SDR', 'value': sdr}, {'metric': 'NMSE', 'value': nmse}, {'metric': 'bias_MD', 'value': md}, {'metric': 'abs_bias_MD', 'value': abs(md)}, {'metric': 'bias_MC', 'value': mc}, {'metric': 'abs_bias_MC', 'value': abs(mc)}], recursive := true) FROM v)"""


def _study(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    rows = li.groupBy(
        F.when(F.col("l_linestatus") == "O", "stationary").otherwise("non_stationary").alias("condition"),
        F.when(F.col("l_orderkey") % 2 == 0, "artery").otherwise("vein").alias("vessel_type"),
        F.col("l_suppkey").alias("cluster"),
        F.col("l_linenumber").alias("config"),
        F.when(F.col("l_returnflag") == "A", "rpca").when(F.col("l_returnflag") == "N", "sms_avg").otherwise("sms").alias("method"),
    ).agg(F.max(F.col("l_partkey") % 101).alias("sdr"), F.max(F.col("l_orderkey") % 37).alias("nmse"), (F.max(F.col("l_partkey") % 23) - 11).alias("bias_MD_c0"), (F.max(F.col("l_quantity").cast("long") % 13) - 6).alias("bias_MC_c0"))
    return C.measures(rows, ["condition", "vessel_type", "cluster", "config", "method"])


_PAIR = "max(value) FILTER (method = '{0}') - max(value) FILTER (method = '{1}')"


@query(
    "study_comparisons",
    f"""WITH {_STUDY}, w AS (SELECT 'rpca vs sms_avg (' || condition || ')' AS comparison, condition, vessel_type, metric, cluster, config, {_PAIR.format('rpca', 'sms_avg')} AS d FROM long GROUP BY ALL
UNION ALL SELECT 'rpca vs sms (' || condition || ')', condition, vessel_type, metric, cluster, config, {_PAIR.format('rpca', 'sms')} FROM long GROUP BY ALL
UNION ALL SELECT 'sms_avg stationary vs non-stationary' || CASE WHEN metric LIKE 'abs%' THEN ' (|bias|)' ELSE '' END, 'cross', vessel_type, metric, cluster, config, max(value) FILTER (condition = 'stationary') - max(value) FILTER (condition = 'non_stationary') FROM long WHERE method = 'sms_avg' AND metric LIKE '%bias%' GROUP BY ALL),
c AS (SELECT comparison, condition, vessel_type, metric, cluster, median(d) AS d, count(*) AS n FROM w WHERE d IS NOT NULL GROUP BY ALL)
SELECT comparison, condition, vessel_type, metric, CAST(count(*) AS INTEGER) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_samples, CASE WHEN count(*) >= 3 THEN median(d) END AS median,
  comparison = 'rpca vs sms_avg (non_stationary)' AND (metric = 'abs_bias_MD' OR vessel_type = 'artery' AND metric = 'abs_bias_MC') AS "primary" FROM c GROUP BY ALL""",
)
def study_comparisons(spark, sf_dir):
    """Five families of comparisons of a study of three methods in two conditions; intervals and p values are left to the tests."""
    return C.compared(_study(spark, sf_dir), "cluster", 500).select(*C.BY, "n_clusters", "n_samples", "median", "primary")


@query("amplitude_summary", f"WITH {_STUDY} SELECT vessel_type, condition, method, metric, median(value) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, count(value) AS n FROM long WHERE metric LIKE '%bias%' GROUP BY ALL")
def amplitude_summary(spark, sf_dir):
    """Signed and absolute biases of amplitudes by vessel, condition and method."""
    return rounded(C.amplitude_summary(_study(spark, sf_dir)), "mean", "sd", digits=9)


# What SQL can say of results that it cannot compute.


@query("rpca_invariants", CELLS_SQL + f" SELECT {IDS}, count(*) AS n, count(x) AS n_observed, 0 AS off_mask, 0 AS missing, TRUE AS within, CAST(NULL AS VARCHAR) AS error FROM cells GROUP BY ALL")
def rpca_invariants(spark, sf_dir):
    """Every cell is decomposed, nothing is sparse where nothing was observed, and no run takes more iterations than it may."""
    parts = N.decompose(cells(spark, sf_dir), P, N.RpcaConfig(support_frac=0.6))
    sums = [F.count("*").alias("n"), F.count("x").alias("n_observed"), F.count_if(~F.col("m") & (F.col("a") != 0)).cast("int").alias("off_mask"), F.count_if(F.col("s").isNull() | F.isnan("s")).cast("int").alias("missing")]
    return parts.groupBy(*SEG).agg(*sums, (F.max("iterations") <= 70).alias("within"), F.max("error").alias("error"))


@query("effective_rank_bounds", "SELECT label, CAST(len(any_value(embedding)) AS INTEGER) AS n_loci, CAST(count(*) AS INTEGER) AS n_samples, TRUE AS shares FROM embeddings GROUP BY ALL")
def effective_rank_bounds(spark, sf_dir):
    """Sizes of every group's matrix, and shares of its two first components that are in order and no more than the whole."""
    rows = load(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("k", "v"))
    out = N.effective_rank(rows, ["label"], "vec_id", "k", "v")
    return out.select("label", F.col("n_loci").cast("int").alias("n_loci"), F.col("n_samples").cast("int").alias("n_samples"), ((F.col("pc1") >= F.col("pc2")) & (F.col("pc2") >= 0) & (F.col("pc1") + F.col("pc2") <= 1 + 1e-9)).alias("shares"))


@query("vessel_predicates", CELLS_SQL + f" SELECT DISTINCT {IDS}, lower(vessel_type) LIKE 'a%' OR upper(segment_label) LIKE 'A%' AS artery, lower(vessel_type) LIKE 'v%' OR upper(segment_label) LIKE 'V%' AS vein FROM cells")
def vessel_predicates(spark, sf_dir):
    kind, label = F.col("vessel_type"), F.col("segment_label")
    return cells(spark, sf_dir).select(*SEG, is_artery(kind, label).alias("artery"), is_vein(kind, label).alias("vein")).distinct()


@query("quality_flat", CELLS_SQL + f" SELECT {IDS}, count(DISTINCT locus) AS n_loci, 'night' AS run_name, 'raw' AS stage, 'dataset' AS scope, TRUE AS nested_is_text FROM cells GROUP BY ALL")
def quality_flat(spark, sf_dir):
    """The quality report as one flat row a segment, for files without nested values."""
    out = V.flat(V.report(cells(spark, sf_dir), P, V.Thresholds(min_loci=3)), "night")
    text = dict(out.dtypes)["gaps"] == "string"
    return out.select(*SEG, "n_loci", "run_name", "stage", "scope", F.lit(text).alias("nested_is_text"))
