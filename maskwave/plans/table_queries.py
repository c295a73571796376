"""Queries over tables of results: metrics, summaries, comparisons, joins, reports; and the reader on text built from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import soft_threshold
from ..operators import aggregates as A
from ..operators import biomarkers as B
from ..operators import denoise as N
from ..operators import hybrid as H
from ..operators import metrics as M
from ..operators import sequences as S
from ..operators import smoothing as D
from ..sources import reader as R
from ..sources.cells import CELLS_SQL, KEY
from ..sources.sinks import widen
from ..streaming import gaps as G
from .registry import IDS, SEG, TRACES_SQL, P, cells, load, query, rounded, traces
from .sequence_queries import _SMS
from .signal_queries import BIOMARKER_SQL

_PAIR = _SMS + f""", raw AS (SELECT {IDS}, t_idx, 100 * ((y - b) / b) AS y FROM (SELECT *, median(y) FILTER (t < 20) OVER (PARTITION BY {IDS}) AS b FROM tr)),
p AS (SELECT {IDS}, t_idx, s.y AS truth, raw.y AS corrupt, (s.y + raw.y) / 2 AS found FROM s JOIN raw USING ({IDS}, t_idx))
"""


def _pairs(spark, sf_dir):
    """The smoothed trace as truth, the raw one as corrupted, their mean as recovered."""
    tr = traces(spark, sf_dir)
    raw = S.percent_of_window(tr, P.reference(), SEG).select(*SEG, "t_idx", F.col("y").alias("corrupt"))
    truth = D.sms(tr, P).select(*SEG, "vessel_type", "t_idx", "t", F.col("y").alias("truth"))
    return truth.join(raw, [*SEG, "t_idx"]).withColumn("found", (F.col("truth") + F.col("corrupt")) / 2)


def _db(a: str, b: str) -> str:
    on = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"CASE WHEN count(*) {on} < 2 THEN NULL WHEN sum(({a} - {b}) ** 2) {on} = 0 THEN 60 ELSE 10 * log10(sum({a} * {a}) {on} / (sum(({a} - {b}) ** 2) {on})) END"


@query("fidelity", _PAIR + f"""SELECT {IDS}, round({_db('truth', 'found')}, 6) AS sdr, round(sum((truth - found) ** 2) / sum(truth * truth) FILTER (found IS NOT NULL), 6) AS nmse,
  round({_db('truth', 'found')} - ({_db('truth', 'corrupt')}), 6) AS delta_sdr, round(avg((truth IS NOT NULL AND found IS NOT NULL)::INT), 6) AS support FROM p GROUP BY ALL""")
def fidelity(spark, sf_dir):
    return rounded(M.fidelity(_pairs(spark, sf_dir), SEG, support=0.0), "sdr", "nmse", "delta_sdr", "support")


def _bias(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("method", F.lit("mean"))
    cols = [*SEG, "vessel_type", "method", "t_idx", "t"]
    return M.bias(p.select(*cols, F.col("truth").alias("y")), p.select(*cols, F.col("found").alias("y")), P)


def _measures_sql(value: str) -> str:
    """The compared biomarkers of one column of the pairs, in a scope in which it is the trace."""
    own = f"SELECT {IDS}, vessel_type, t_idx, t, {value} AS y FROM q"
    return f"""(WITH tr AS ({own}){BIOMARKER_SQL[len(TRACES_SQL):]} SELECT {IDS}, cycle_index, dil_max_ext - bd AS MD, con_max - bd AS MC, (dil_max_ext - bd) - (con_max - bd) AS DA,
  dil_max_30_t_ext AS tMAD30, CASE WHEN bd IS NOT NULL THEN dil_max_t_ext END AS tMAD FROM al)"""


_BIAS_SQL = _PAIR + f""", q AS (SELECT p.*, tr.vessel_type, tr.t FROM p JOIN tr USING ({IDS}, t_idx)),
a AS {_measures_sql('truth')}, b AS {_measures_sql('found')},
d AS (SELECT {IDS}, b.cycle_index, n.n AS biomarker, CASE n.n WHEN 'MD' THEN b.MD - a.MD WHEN 'MC' THEN b.MC - a.MC WHEN 'DA' THEN b.DA - a.DA WHEN 'tMAD30' THEN b.tMAD30 - a.tMAD30 ELSE b.tMAD - a.tMAD END AS bias
  FROM b JOIN a USING ({IDS}, cycle_index), (VALUES ('MD'), ('MC'), ('DA'), ('tMAD30'), ('tMAD')) n(n) WHERE n.n NOT IN ('MC', 'DA') OR segment_label LIKE 'A%')
"""


@query("biomarker_bias", _BIAS_SQL + f"SELECT {IDS}, 'mean' AS method, cycle_index, biomarker, round(bias, 6) + 0 AS bias FROM d")
def biomarker_bias(spark, sf_dir):
    return _bias(spark, sf_dir).drop("vessel_type").withColumn("bias", F.round("bias", 6) + 0)


@query("plateau_instability", _BIAS_SQL + f"SELECT {IDS}, round(avg((abs(bias) > 0.5)::INT), 6) AS instability FROM d WHERE biomarker = 'tMAD' AND bias IS NOT NULL GROUP BY ALL")
def plateau_instability(spark, sf_dir):
    return rounded(M.plateau_instability(_bias(spark, sf_dir), SEG), "instability")


# Summaries and comparisons.

_LINES = "lineitem"


@query("group_summary", "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, count(l_extendedprice) AS n FROM lineitem GROUP BY ALL")
def group_summary(spark, sf_dir):
    out = A.group_summary(load(spark, sf_dir, _LINES), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return rounded(rounded(out, "q25", "q75"), "mean", "sd", digits=4)


@query("summary_with_all", "SELECT coalesce(l_returnflag, 'all') AS l_returnflag, l_linestatus, median(l_discount - 0.05::DOUBLE) AS median, median(abs(l_discount - 0.05::DOUBLE)) AS median_abs, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))")
def summary_with_all(spark, sf_dir):
    df = load(spark, sf_dir, _LINES).withColumn("d", F.col("l_discount") - 0.05)
    return A.summary_with_all(df, "l_returnflag", "l_linestatus", "d")


@query("bland_altman", """WITH d AS (SELECT l_returnflag, l_suppkey, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag, l_suppkey) AS d FROM lineitem)
SELECT l_returnflag, round(avg(d), 3) + 0 AS bias, round(stddev_samp(d), 4) AS sd, count(*) AS n, count(DISTINCT l_suppkey) AS n_subjects, round(avg(d) - 1.96 * stddev_samp(d), 4) AS loa_low, round(avg(d) + 1.96 * stddev_samp(d), 4) AS loa_high FROM d GROUP BY ALL""")
def bland_altman(spark, sf_dir):
    out = A.bland_altman(load(spark, sf_dir, _LINES), "l_suppkey", "l_extendedprice", ["l_returnflag"])
    return rounded(out, "sd", "loa_low", "loa_high", digits=4).withColumn("bias", F.round("bias", 3) + 0)


@query("correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY ALL")
def correlation(spark, sf_dir):
    return rounded(A.correlation(load(spark, sf_dir, _LINES), "l_quantity", "l_extendedprice", ["l_returnflag"]), "r")


@query("histogram", "SELECT l_linestatus, CAST(least(floor((l_quantity - 0) / 5.0::DOUBLE), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL")
def histogram(spark, sf_dir):
    return A.histogram(load(spark, sf_dir, _LINES), "l_quantity", 0, 50, 10, ["l_linestatus"])


@query("rank_distribution", BIOMARKER_SQL + f""", r AS (SELECT segment_label, cycle_index, ['highest','middle','lowest','extra'][least(row_number() OVER (PARTITION BY {IDS} ORDER BY dil_max - bd DESC NULLS LAST, cycle_index), 4)] AS rank FROM one),
g AS (SELECT * FROM (SELECT DISTINCT segment_label FROM r), (VALUES ('highest'), ('middle'), ('lowest')) a(rank), range(3) b(cycle_index)), n AS (SELECT segment_label, rank, cycle_index, count(*) AS n FROM r GROUP BY ALL)
SELECT segment_label, rank, CAST(cycle_index AS INTEGER) AS cycle_index, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY segment_label, rank) AS BIGINT) AS total, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY segment_label, rank), 6) AS fraction
FROM g LEFT JOIN n USING (segment_label, rank, cycle_index)""")
def rank_distribution(spark, sf_dir):
    table = B.biomarkers(traces(spark, sf_dir), P).select(*SEG, "cycle_index", "dil_max_bc")
    ranked = S.rank_cycles(table, SEG, "dil_max_bc")
    return rounded(A.rank_distribution(ranked, ["segment_label"], "rank", "cycle_index", ["highest", "middle", "lowest"], [0, 1, 2]), "fraction")


@query("pivot_grid", "SELECT l_shipmode_ AS k, max(CASE WHEN l_returnflag = 'A' THEN m END) AS A, max(CASE WHEN l_returnflag = 'N' THEN m END) AS N, max(CASE WHEN l_returnflag = 'R' THEN m END) AS R FROM (SELECT l_linenumber AS l_shipmode_, l_returnflag, median(l_tax) AS m FROM lineitem GROUP BY ALL) GROUP BY ALL")
def pivot_grid(spark, sf_dir):
    long = load(spark, sf_dir, _LINES).groupBy(F.col("l_linenumber").alias("k"), "l_returnflag").agg(F.median("l_tax").alias("m"))
    return widen(long, ["k"], "l_returnflag", "m", ["A", "N", "R"])


@query("top_rows", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def top_rows(spark, sf_dir):
    return M.best_rows(load(spark, sf_dir, _LINES).select("l_orderkey", "l_linenumber", "l_extendedprice"), 10, "l_extendedprice", "l_orderkey", "l_linenumber")


@query("nearest_to_median", "SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderstatus) AS mid FROM orders) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY abs(o_totalprice - mid), o_orderkey) = 1")
def nearest_to_median(spark, sf_dir):
    return M.nearest_to_median(load(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey", "o_totalprice")


@query("best_covered_segment", CELLS_SQL + f""", w AS (SELECT {IDS}, CAST(floor((t - 50) / 100) AS INT) AS c, avg(m::INT) AS cov FROM cells WHERE t >= 50 AND (t - 50) % 100 < 20 AND t < 320 GROUP BY ALL), s AS (SELECT {IDS}, min(cov) AS worst FROM w GROUP BY ALL)
SELECT subject_id, segment_label, round(worst, 6) AS worst FROM s QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY worst DESC, segment_label) = 1""")
def best_covered_segment(spark, sf_dir):
    c = cells(spark, sf_dir).where(P.in_phase(F.col("t"), "flicker")).withColumn("c", F.floor((F.col("t") - 50) / 100))
    worst = c.groupBy(*SEG, "c").agg(F.avg(F.col("m").cast("int")).alias("cov")).groupBy(*SEG).agg(F.min("cov").alias("worst"))
    best = worst.groupBy("subject_id").agg(F.min_by(F.struct("segment_label", "worst"), F.struct(-F.col("worst"), F.col("segment_label"))).alias("b"))
    return rounded(best.select("subject_id", "b.segment_label", "b.worst"), "worst")


@query("loci_by_coverage", CELLS_SQL + f", r AS (SELECT {IDS}, locus, avg(m::INT) AS rate FROM cells GROUP BY ALL) SELECT {IDS}, locus, round(rate, 6) AS rate, CAST(row_number() OVER (PARTITION BY {IDS} ORDER BY rate DESC, locus) AS INTEGER) AS place FROM r")
def loci_by_coverage(spark, sf_dir):
    from pyspark.sql import Window as W

    rate = cells(spark, sf_dir).groupBy(*SEG, "locus").agg(F.avg(F.col("m").cast("int")).alias("rate"))
    return rounded(rate.withColumn("place", F.row_number().over(W.partitionBy(*SEG).orderBy(F.desc("rate"), "locus"))), "rate")


@query("cycle_triplets", BIOMARKER_SQL + f""", v AS (SELECT {IDS}, max(dil_max - bd) FILTER (cycle_index = 0) AS v0, max(dil_max - bd) FILTER (cycle_index = 1) AS v1, max(dil_max - bd) FILTER (cycle_index = 2) AS v2 FROM one GROUP BY ALL),
f AS (SELECT *, 0.05::DOUBLE * (greatest(v0, 0) + greatest(v1, 0) + greatest(v2, 0)) / ((v0 > 0)::INT + (v1 > 0)::INT + (v2 > 0)::INT) AS l FROM v WHERE v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL AND (v0 > 0 OR v1 > 0 OR v2 > 0)),
g AS (SELECT {IDS}, greatest(v0, l) AS a, greatest(v1, l) AS b, greatest(v2, l) AS c, (greatest(v0, l) + greatest(v1, l) + greatest(v2, l)) / 3 AS m FROM f)
SELECT {IDS}, round(m, 6) AS mean_md, round(a / m, 6) AS m0, round(b / m, 6) AS m1, round(c / m, 6) AS m2, round(sqrt(((a / m - 1) ** 2 + (b / m - 1) ** 2 + (c / m - 1) ** 2) / 2), 6) AS cv FROM g""")
def cycle_triplets(spark, sf_dir):
    table = B.biomarkers(traces(spark, sf_dir), P).select(*SEG, "cycle_index", "dil_max_bc")
    return rounded(M.triplets(table, SEG, "dil_max_bc"), "mean_md", "m0", "m1", "m2", "cv")


_PHASE = "CASE WHEN t < 50 OR t >= 120 AND t < 150 OR t >= 220 AND t < 250 THEN 'baseline' WHEN t >= 70 AND t < 120 OR t >= 170 AND t < 220 OR t >= 270 AND t < 320 THEN 'recovery' END"


@query("noise_stationarity", f"""{_SMS}, ph AS (SELECT {IDS}, t_idx, y, {_PHASE} AS phase FROM tr), c AS (SELECT *, y - avg(y) OVER (PARTITION BY {IDS}, phase) AS c FROM ph WHERE phase IS NOT NULL AND y IS NOT NULL),
l AS (SELECT *, lag(c) OVER (PARTITION BY {IDS}, phase ORDER BY t_idx) AS l FROM c), a AS (SELECT {IDS}, phase, stddev_pop(y) AS sd, avg(c * l) / avg(c * c) AS ac FROM l GROUP BY ALL),
w AS (SELECT {IDS}, max(sd) FILTER (phase = 'recovery') AS r, max(sd) FILTER (phase = 'baseline') AS b, max(ac) FILTER (phase = 'baseline') AS ab, max(ac) FILTER (phase = 'recovery') AS ar FROM a GROUP BY ALL)
SELECT {IDS}, round(r, 6) AS sd_recovery, round(b, 6) AS sd_baseline, round(ab, 6) AS ac1_baseline, round(ar, 6) AS ac1_recovery, round(r / b, 6) AS ratio FROM w""")
def noise_stationarity(spark, sf_dir):
    return rounded(M.noise_stationarity(traces(spark, sf_dir), P), "sd_recovery", "sd_baseline", "ac1_baseline", "ac1_recovery", "ratio")


# Joins and sets.


@query("inclusion_semi_join", CELLS_SQL + f" SELECT {IDS}, count(x) AS n_valid FROM cells WHERE (segment_label = 'A1' AND subject_id IN ('0', '1')) OR (segment_label = 'V3' AND subject_id = '1') GROUP BY ALL")
def inclusion_semi_join(spark, sf_dir):
    lists = spark.createDataFrame([('{"A1": ["0", "1"], "V3": ["1", "77"], "_comment": ["kept"]}',)], "content string")
    kept = R.keep_included(cells(spark, sf_dir), R.inclusion_list(lists))
    return kept.groupBy(*SEG).agg(F.count("x").alias("n_valid"))


@query("left_join_missing", "SELECT c_custkey, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY ALL")
def left_join_missing(spark, sf_dir):
    """Rows without a partner stay, with missing values."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    out = load(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").groupBy("c_custkey")
    return rounded(out.agg(F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("total")), "total", digits=2)


@query("strict_join_check", "SELECT count(*) AS n_missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def strict_join_check(spark, sf_dir):
    """What a strict lookup would fail on: keys without a partner."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").agg(F.count("*").alias("n_missing"))


@query("paired_pivot", """WITH m AS (SELECT l_suppkey, l_linenumber, avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS a, avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
d AS (SELECT l_suppkey, round(a - b, 9) AS d FROM m WHERE a IS NOT NULL AND b IS NOT NULL) SELECT l_suppkey, round(median(d), 6) AS d, count(*) AS n FROM d GROUP BY ALL""")
def paired_pivot(spark, sf_dir):
    """Two methods side by side on common keys, and each cluster's median difference."""
    wide = load(spark, sf_dir, _LINES).groupBy("l_suppkey", "l_linenumber").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_discount"))
    wide = wide.withColumns({"A": F.round(F.col("A") - F.col("R"), 9), "R": F.when(F.col("R").isNotNull(), 0.0)})
    return rounded(M.paired(wide.withColumn("g", F.lit(0)), [], "l_suppkey", "A", "R"), "d")


@query("cluster_statistics")
def cluster_statistics(spark, sf_dir):
    wide = load(spark, sf_dir, _LINES).groupBy("l_linenumber", "l_suppkey", "l_quantity").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_discount"))
    return M.cluster_stats(M.paired(wide, ["l_linenumber"], "l_suppkey", "A", "R"), ["l_linenumber"])


@query("set_operations", CELLS_SQL + f", a AS (SELECT {IDS}, t_idx FROM cells WHERE segment_label = 'A1' AND m), b AS (SELECT {IDS}, t_idx FROM cells WHERE segment_label = 'V3' AND m) SELECT *, 'artery' AS kind FROM (SELECT DISTINCT * FROM a) UNION ALL SELECT *, 'vein' AS kind FROM (SELECT DISTINCT * FROM b)")
def set_operations(spark, sf_dir):
    c = cells(spark, sf_dir).where("m")
    part = lambda label, kind: c.where(F.col("segment_label") == label).select(*SEG, "t_idx").distinct().withColumn("kind", F.lit(kind))
    return part("A1", "artery").unionByName(part("V3", "vein"))


# Scalars and the reader.


@query("scalar_functions", "SELECT s_suppkey, upper(substr(trim(s_name), 1, 1)) AS first, split_part(s_name, '#', -1) AS last, round(sign(s_acctbal - 5000) * greatest(abs(s_acctbal - 5000) - 100, 0), 6) + 0 AS soft, round(log10(abs(s_acctbal) + 1), 6) AS lg, round(exp(-s_acctbal / 10000), 6) AS ex, round(sin(s_acctbal), 6) AS sn FROM supplier")
def scalar_functions(spark, sf_dir):
    b = F.col("s_acctbal")
    out = load(spark, sf_dir, "supplier").select("s_suppkey", F.upper(F.substring(F.trim("s_name"), 1, 1)).alias("first"), F.split_part("s_name", F.lit("#"), F.lit(-1)).alias("last"), soft_threshold(b - 5000, 100.0).alias("soft"), F.log10(F.abs(b) + 1).alias("lg"), F.exp(-b / 10000).alias("ex"), F.sin(b).alias("sn"))
    return rounded(out, "soft", "lg", "ex", "sn").withColumn("soft", F.col("soft") + 0)


@query("reader_cells", "SELECT 'S' || o_custkey AS subject_id, '0' AS visit_id, 'A1' AS segment_label, 'artery' AS vessel_type, CAST(k AS INTEGER) AS t_idx, k / 25.0::DOUBLE AS t, CAST(l AS INTEGER) AS locus, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) + l AS DOUBLE) AS x, TRUE AS m FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), range(2) r(l) WHERE n >= 2")
def reader_cells(spark, sf_dir):
    """Files built from orders, one a customer, with a header, decimal commas and tabs, and read back by the reader."""
    o = load(spark, sf_dir, "orders")
    line = F.concat_ws("\t", F.replace(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")), (F.col("o_totalprice").cast("decimal(12,2)") + F.lit(1)).cast("string"))
    path = F.concat(F.lit("/data/S"), "o_custkey", F.lit("_0_A1.txt"))
    return R.parse(R.built(o, path, "o_orderkey", line, "Diameters complete\nname\n\nPosition -> position"), P.__class__("p", 25.0)).drop("dropped")


# Kernels and hybrids: tested by properties, brute force and closed forms.

#: The events have five loci, so support is three of them; all else is the configuration's own.
_SMALL = N.RpcaConfig(support_frac=0.6)


@query("rpca_trace")
def rpca_trace(spark, sf_dir):
    return N.rpca_trace(cells(spark, sf_dir), P, _SMALL)


@query("rpca_components")
def rpca_components(spark, sf_dir):
    return N.decompose(cells(spark, sf_dir), P, _SMALL)


@query("group_rpca_trace")
def group_rpca_trace(spark, sf_dir):
    return N.group_rpca_trace(cells(spark, sf_dir), P)


@query("heartbeats")
def heartbeats(spark, sf_dir):
    return N.heartbeats(S.interpolate(traces(spark, sf_dir), SEG), 4.0)


@query("lowpass_cells")
def lowpass_cells(spark, sf_dir):
    return N.lowpass_cells(cells(spark, sf_dir), 1.0, 0.2)


@query("effective_rank")
def effective_rank(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("k", "v"))
    return N.effective_rank(rows, ["label"], "vec_id", "k", "v")


@query("hybrid_fidelity")
def hybrid_fidelity(spark, sf_dir):
    """Hybrids of every segment, ten configurations, and how two smoothers recover their truth."""
    hybrid = H.as_segments(H.build(cells(spark, sf_dir), P, n_configs=10))
    truth = hybrid.groupBy(*KEY, "t_idx").agg(F.first("truth").alias("truth"))
    tr = A.aggregate_loci(hybrid).withColumn("method", F.lit("sms"))
    corrupt = S.percent_of_window(tr, P.reference(), [*KEY]).select(*KEY, "t_idx", F.col("y").alias("corrupt"))
    parts = None
    for name, f in (("sms", D.sms), ("sms_avg", D.sms_average)):
        part = f(tr, P).select(*KEY, "t_idx", F.col("y").alias("found")).withColumn("method", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    pairs = parts.join(truth, [*KEY, "t_idx"]).join(corrupt, [*KEY, "t_idx"])
    return M.fidelity(pairs, [*KEY, "method"], support=0.0)


@query("hybrid_simple")
def hybrid_simple(spark, sf_dir):
    """Hybrids of the response without knots: one configuration of every segment."""
    return H.build_simple(cells(spark, sf_dir), P)


@query("hybrid_artefacts")
def hybrid_artefacts(spark, sf_dir):
    """What impulses and bursts add to every cell of every segment's first configuration."""
    plain, with_ = H.build(cells(spark, sf_dir), P, 1), H.build(cells(spark, sf_dir), P, 1, artefacts=H.Artefacts())
    keys = [*KEY, "config", "t_idx", "locus"]
    both = with_.select(*keys, "x").join(plain.select(*keys, F.col("x").alias("without")), keys)
    return both.select(*keys, F.round(F.col("x") - F.col("without"), 6).alias("artefact"))


@query("batch_windowed_missing", "SELECT CAST(user_id % 4 AS VARCHAR) AS segment, date_trunc('hour', ts) AS \"start\", date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n, count(value) AS n_valid FROM events GROUP BY ALL")
def batch_windowed_missing(spark, sf_dir):
    """The streaming completeness report, on the whole table as one batch."""
    e = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).cast("string").alias("segment"), "value")
    out = G.windowed_missing(e)
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


_GATED = f"SELECT {IDS}, t_idx // 40 AS part, truth, corrupt, found, (truth IS NOT NULL AND found IS NOT NULL)::INT AS there FROM p"


@query("fidelity_gated", _PAIR + f""", g AS ({_GATED}), a AS (SELECT {IDS}, part, avg(there) >= 0.75 AS enough, {_db('truth', 'found')} AS sdr, CASE WHEN count(*) FILTER (there = 1) >= 2 AND sum(truth * truth) FILTER (there = 1) > 0 THEN sum((truth - found) ** 2) FILTER (there = 1) / sum(truth * truth) FILTER (there = 1) END AS nmse, {_db('truth', 'corrupt')} AS sdr_in, avg(there) AS support FROM g GROUP BY ALL)
SELECT {IDS}, part, round(CASE WHEN enough THEN sdr END, 6) AS sdr, round(CASE WHEN enough THEN nmse END, 6) AS nmse, round(CASE WHEN enough THEN sdr - sdr_in END, 6) AS delta_sdr, round(support, 6) AS support FROM a""")
def fidelity_gated(spark, sf_dir):
    """Distances over stretches of 40 frames, only where three quarters of a stretch have a pair."""
    pairs = _pairs(spark, sf_dir).withColumn("part", F.floor(F.col("t_idx") / 40))
    return rounded(M.fidelity(pairs, [*SEG, "part"], support=0.75), "sdr", "nmse", "delta_sdr", "support")


@query("paired_cluster_medians", f"""WITH w AS (SELECT l_linenumber, l_suppkey, l_quantity, avg(l_discount) FILTER (l_returnflag = 'A') - avg(l_discount) FILTER (l_returnflag = 'R') AS d FROM {_LINES} GROUP BY ALL)
SELECT l_linenumber, l_suppkey, round(median(d), 9) + 0.0::DOUBLE AS d, count(*) AS n FROM w WHERE d IS NOT NULL GROUP BY ALL""")
def paired_cluster_medians(spark, sf_dir):
    """What the cluster statistics start from: each cluster's median difference of two methods, by group."""
    wide = load(spark, sf_dir, _LINES).groupBy("l_linenumber", "l_suppkey", "l_quantity").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_discount"))
    return rounded(M.paired(wide, ["l_linenumber"], "l_suppkey", "A", "R"), "d", digits=9).withColumn("d", F.col("d") + 0.0)


@query("hybrid_simple_residuals", CELLS_SQL + f""", h AS (SELECT {IDS}, locus, x, row_number() OVER (PARTITION BY {IDS}, locus ORDER BY t_idx) - 1 AS k, count(*) OVER (PARTITION BY {IDS}, locus) AS n, median(x) OVER (PARTITION BY {IDS}, locus) AS rest FROM cells WHERE t < 20)
SELECT c.subject_id, c.visit_id, c.segment_label, c.t_idx, c.locus, c.m AND h.rest IS NOT NULL AS m, round(CASE WHEN c.m THEN coalesce(h.x - h.rest, CASE WHEN h.rest IS NOT NULL THEN 0 END) END, 6) AS residual
FROM cells c JOIN h ON h.subject_id = c.subject_id AND h.visit_id = c.visit_id AND h.segment_label = c.segment_label AND h.locus = c.locus AND h.k = c.t_idx % h.n""")
def hybrid_simple_residuals(spark, sf_dir):
    """What a simple hybrid has beside its response: the baseline's residual, repeated, on the recording's own mask."""
    c = cells(spark, sf_dir)
    rest = A.baseline_per_locus(c, P.reference())
    both = H.build_simple(c, P).join(rest, [*KEY, "locus"], "left")
    residual = F.col("x") - F.col("base") * (1 + F.col("truth") / 100)
    return rounded(both.select(*SEG, "t_idx", "locus", "m", residual.alias("residual")), "residual")
