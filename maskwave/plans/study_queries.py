"""Queries of whole studies: tables of several preprocessors, evaluations on hybrids, sweeps, comparisons. Levels are columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import biomarkers as B
from ..operators import denoise as N
from ..operators import evaluation as E
from ..operators import hybrid as H
from ..operators import metrics as M
from ..operators import ranking as K
from ..operators import sequences as S
from ..sources.cells import KEY
from ..sources.sinks import widen
from .registry import IDS, SEG, TRACES_SQL, P, cells, load, over_cycles, query, rounded, traces
from .sequence_queries import _CUT, _stack
from .signal_queries import BIOMARKER_SQL
from .table_queries import _SMALL

_RPCA = {"support_frac": _SMALL.support_frac}


@query("pipeline_parameters")
def pipeline_parameters(spark, sf_dir):
    """The parameter table of the four preprocessors that the facade offers."""
    return E.parameters(cells(spark, sf_dir), P, ("rpca", "group_rpca", "kotliar", "gherghel"), options={"rpca": _RPCA})


def _evaluated(spark, sf_dir, n_configs=10):
    return E.evaluate(H.build(cells(spark, sf_dir), P, n_configs), P, support=0.6, config=_SMALL)


@query("hybrid_evaluation")
def hybrid_evaluation(spark, sf_dir):
    """Five methods on ten configurations of every segment: distances over supported frames, plateau, biases."""
    return _evaluated(spark, sf_dir)


def _swept(spark, sf_dir, knob, levels, methods):
    hybrid = H.build(cells(spark, sf_dir), P, 2, sweep=(knob, levels))
    out = E.evaluate(hybrid, P, methods, support=0.6, config=_SMALL, by=("level",))
    return out.groupBy("level", "method").agg(F.median("sdr").alias("median_sdr"), F.avg("sdr").alias("mean_sdr"), F.median("delta_sdr").alias("median_delta"), F.median("sdr_c2").alias("median_sdr_c2"), F.count("sdr").alias("n"))


@query("drift_sweep")
def drift_sweep(spark, sf_dir):
    return _swept(spark, sf_dir, "drift", (0.0, 0.5, 1.0, 2.0), ("rpca", "sms"))


@query("rank_sweep")
def rank_sweep(spark, sf_dir):
    """Loci whose amplitudes differ more and more, which one component cannot hold."""
    return _swept(spark, sf_dir, "variability", (0.0, 0.05, 0.10, 0.15, 0.20), ("rpca",))


@query("attenuation_sweep")
def attenuation_sweep(spark, sf_dir):
    """A last cycle that is weaker and weaker; a column for each method."""
    long = _swept(spark, sf_dir, "attenuation", (1.0, 0.7, 0.5, 0.3, 0.0), ("rpca", "sms", "sms_avg"))
    return widen(long, ["level"], "method", "median_sdr", ["rpca", "sms", "sms_avg"])


@query("sensitivity_grid")
def sensitivity_grid(spark, sf_dir):
    return E.grid_search(H.build(cells(spark, sf_dir), P, 1), P, (0.1, 0.3, 0.55, 0.8, 1.0, 1.5), (0.0, 10.0, 100.0, 500.0, 1000.0, 5000.0), _SMALL, support=0.6)


def non_stationary_study(spark, sf_dir):
    """Hybrids scaled by measured triplets, three methods, and their comparison by segments with Holm's adjustment; not registered, as it takes
    over two minutes at sf0.01."""
    c = cells(spark, sf_dir)
    triplets = M.triplets(B.biomarkers(traces(spark, sf_dir), P).select(*SEG, "cycle_index", "dil_max_bc"), SEG, "dil_max_bc")
    rows = E.evaluate(E.non_stationary(triplets, c, P, 3), P, ("rpca", "sms", "sms_avg"), support=0.6, config=_SMALL)
    families = {"rpca over sms": ("rpca", "sms", False), "rpca over sms_avg": ("rpca", "sms_avg", False), "sms over sms_avg": ("sms", "sms_avg", False)}
    rows = rows.withColumn("cluster", F.concat_ws("/", "subject_id", "segment_label"))
    return M.compare_methods(rows, "sdr", "cluster", families, ("rpca over sms", "rpca over sms_avg"), [*KEY, "config", "cluster"])


@query("noise_ratio_test")
def noise_ratio_test(spark, sf_dir):
    return M.ratio_test(M.noise_stationarity(traces(spark, sf_dir), P), "segment_label")


_DIFFERENCES = "SELECT l_returnflag AS g, CAST(l_partkey - 20 * l_suppkey AS DOUBLE) AS d FROM lineitem"


def _differences(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_partkey") - 20 * F.col("l_suppkey")).cast("double").alias("d"))


@query(
    "signed_rank_sums",
    f"""WITH r AS ({_DIFFERENCES}), t AS (SELECT g, abs(d) AS size, count(*) AS n, count(*) FILTER (d > 0) AS plus FROM r WHERE d <> 0 GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY size) - (n - 1) / 2.0::DOUBLE AS rank FROM t)
SELECT r.g, r.n_all, CAST(sum(n) AS BIGINT) AS n, CAST(sum(rank * plus) AS DOUBLE) AS w_plus, CAST(sum(rank * (n - plus)) AS DOUBLE) AS w_minus, round(CAST(sum(CAST(n AS DOUBLE) * n * n - n) AS DOUBLE), 0) AS ties
FROM u JOIN (SELECT g, count(*) AS n_all FROM r GROUP BY ALL) r USING (g) GROUP BY ALL""",
)
def signed_rank_sums(spark, sf_dir):
    """Signed-rank sums of every line item's difference of two keys: three groups, the largest of half of all rows."""
    return K.signed_ranks(_differences(spark, sf_dir), ["g"], "d").withColumn("ties", F.round("ties", 0))


@query(
    "value_places",
    f"SELECT g, d, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY g ORDER BY d) - count(*) + 1 AS BIGINT) AS low, CAST(sum(count(*)) OVER (PARTITION BY g ORDER BY d) AS BIGINT) AS high FROM ({_DIFFERENCES}) GROUP BY g, d",
)
def value_places(spark, sf_dir):
    """The places that each distinct value takes among its group's sorted rows."""
    return K.places(_differences(spark, sf_dir), ["g"], "d")


@query("median_interval", f"SELECT g, count(*) AS size, median(d) AS median, TRUE AS inside FROM ({_DIFFERENCES}) GROUP BY ALL")
def median_interval(spark, sf_dir):
    """Medians, and whether the interval of their resamples holds them; the ends themselves are draws, which tests compare with plain resampling."""
    out = K.median_interval(_differences(spark, sf_dir), ["g"], "d")
    return out.select("g", "size", "median", ((F.col("ci_low") <= F.col("median")) & (F.col("median") <= F.col("ci_high"))).alias("inside"))


@query("paired_statistics")
def paired_statistics(spark, sf_dir):
    wide = load(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_suppkey").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_discount"))
    return M.paired_stats(wide, ["l_linenumber"], "A", "R")


@query("cardiac_noise")
def cardiac_noise(spark, sf_dir):
    return N.cardiac_band(cells(spark, sf_dir), P)


@query("average_truth", TRACES_SQL + f""", st AS ({_stack('tr')}), te AS (SELECT {IDS}, off, median(y) AS v FROM st GROUP BY ALL)
SELECT {IDS.replace('subject', 'tr.subject').replace('visit_id', 'tr.visit_id').replace('segment_label', 'tr.segment_label')}, tr.t_idx, round(te.v, 6) AS y FROM tr LEFT JOIN st USING ({IDS}, t_idx) LEFT JOIN te USING ({IDS}, off)""")
def average_truth(spark, sf_dir):
    return rounded(E.average_truth(traces(spark, sf_dir), P).select(*SEG, "t_idx", "y"), "y")


@query("colour_range", TRACES_SQL + f" SELECT {IDS}, round(quantile_cont(y, 0.01) - 0.05 * (quantile_cont(y, 0.99) - quantile_cont(y, 0.01)), 6) AS low, round(quantile_cont(y, 0.99) + 0.05 * (quantile_cont(y, 0.99) - quantile_cont(y, 0.01)), 6) AS high FROM tr GROUP BY ALL")
def colour_range(spark, sf_dir):
    return rounded(A.colour_range(traces(spark, sf_dir), SEG, "y"), "low", "high")


@query("deviating_suppliers", "SELECT l_suppkey, avg(l_quantity) / 25.5::DOUBLE AS m, abs(avg(l_quantity) / 25.5::DOUBLE - 1) > 0.05 AS deviates FROM lineitem GROUP BY ALL")
def deviating_suppliers(spark, sf_dir):
    m = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") / 25.5).alias("m"))
    return m.withColumn("deviates", A.deviates(F.col("m")))


@query("ranked_cycle_traces", BIOMARKER_SQL + f""", r AS (SELECT {IDS}, cycle_index, ['highest','middle','lowest','extra'][least(row_number() OVER (PARTITION BY {IDS} ORDER BY dil_max - bd DESC NULLS LAST, cycle_index), 4)] AS rank FROM one),
c AS ({over_cycles(_CUT)}) SELECT {IDS}, t_idx, CAST(cycle_index AS INTEGER) AS cycle_index, rank, t_rel, round(y, 6) AS y FROM c JOIN r USING ({IDS}, cycle_index)""")
def ranked_cycle_traces(spark, sf_dir):
    tr = traces(spark, sf_dir)
    ranked = S.rank_cycles(B.biomarkers(tr, P).select(*SEG, "cycle_index", "dil_max_bc"), SEG, "dil_max_bc")
    cuts = None
    for c in P.cycles:
        part = S.cut_cycle(tr, c, SEG).select(*SEG, "t_idx", "cycle_index", "t_rel", "y")
        cuts = part if cuts is None else cuts.unionByName(part)
    return rounded(S.traces_of_ranked(ranked, cuts, SEG).select(*SEG, "t_idx", "cycle_index", "rank", "t_rel", "y"), "y")
