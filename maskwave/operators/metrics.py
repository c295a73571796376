"""How well a denoiser recovers a known trace, and statistics that compare denoisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.protocol import Protocol
from ..sources.cells import KEY
from ..sources.shared import written
from . import ranking as R
from .biomarkers import TRACE, biomarkers
from .sequences import autocorrelation, holm


def sdr(truth: Column, found: Column, least: int = 2) -> Column:
    """Signal to distortion in dB as an aggregate over the pairs that are there: 60 without error, NULL without signal or pairs."""
    both = truth.isNotNull() & found.isNotNull()
    error, signal = F.sum(F.when(both, (truth - found) ** 2)), F.sum(F.when(both, truth * truth))
    return F.when(F.count_if(both) < least, None).when(error == 0, 60.0).when(signal > 0, 10 * F.log10(signal / error))


def nmse(truth: Column, found: Column, least: int = 2) -> Column:
    both = truth.isNotNull() & found.isNotNull()
    error, signal = F.sum(F.when(both, (truth - found) ** 2)), F.sum(F.when(both, truth * truth))
    return F.when((F.count_if(both) >= least) & (signal > 0), error / signal)


def fidelity(pairs: DataFrame, by: list[str], support: float = 0.75, within: dict[str, Column] | None = None) -> DataFrame:
    """SDR, NMSE and gain over the corrupted trace from columns truth, corrupt and found; NULL where under ``support`` of the rows have a pair.
    ``within``: further SDRs by name, each over the rows where its condition holds."""
    parts = [sdr(F.when(on, F.col("truth")), F.col("found")).alias(n) for n, on in (within or {}).items()]
    out = pairs.groupBy(*by).agg(*parts, sdr(F.col("truth"), F.col("found")).alias("sdr"), nmse(F.col("truth"), F.col("found")).alias("nmse"), sdr(F.col("truth"), F.col("corrupt")).alias("sdr_in"), F.avg((F.col("truth").isNotNull() & F.col("found").isNotNull()).cast("int")).alias("support"))
    gate = F.col("support") >= support
    out = out.withColumns({n: F.when(gate, F.col(n)) for n in ("sdr", "nmse", *(within or {}))})
    return out.withColumn("delta_sdr", F.col("sdr") - F.col("sdr_in")).drop("sdr_in")


# Biomarkers that are compared, and the measures that they are.
BIASES = {"MD": "dil_max_bc_ext", "MC": "con_max_bc", "DA": "da_bc_ext", "tMAD30": "dil_max_30_t_ext", "tMAD": "dil_max_t_bc_ext"}


def bias(truth: DataFrame, found: DataFrame, protocol: Protocol) -> DataFrame:
    """found less truth for each cycle and biomarker, long: MD, MC and DA (arteries only), tMAD30, tMAD. One truth for all methods."""
    return _bias(truth, found, protocol, [k for k in TRACE if k != "method"])


def bias_of_methods(truth: DataFrame, found: DataFrame, protocol: Protocol) -> DataFrame:
    """The same where each method has a truth of its own."""
    return _bias(truth, found, protocol, TRACE)


def bias_of_kinds(truths: DataFrame, found: DataFrame, protocol: Protocol, kind: Column) -> DataFrame:
    """The same against one of several truths, named by their ``method``; ``kind`` says which one a row of ``found`` is compared with."""
    ids = [k for k in TRACE if k != "method"]
    a = biomarkers(truths, protocol).select(*ids, "cycle_index", F.col("method").alias("kind"), *[F.col(c).alias(f"t_{n}") for n, c in BIASES.items()])
    b = biomarkers(found, protocol).withColumn("kind", kind).select(*TRACE, "cycle_index", "kind", *[F.col(c).alias(f"f_{n}") for n, c in BIASES.items()])
    return _long(b.join(a, [*ids, "cycle_index", "kind"]).drop("kind"))


def timing_bias(bias_: DataFrame, by: list[str], biomarker: str = "tMAD") -> DataFrame:
    """Median of a time's bias over cycles."""
    return bias_.where(F.col("biomarker") == biomarker).groupBy(*by).agg(F.median("bias").alias("timing_bias"), F.count("bias").alias("n"))


def _bias(truth: DataFrame, found: DataFrame, protocol: Protocol, ids: list[str]) -> DataFrame:
    names = BIASES
    a = biomarkers(truth, protocol).select(*ids, "cycle_index", *[F.col(c).alias(f"t_{n}") for n, c in names.items()])
    b = biomarkers(found, protocol).select(*TRACE, "cycle_index", *[F.col(c).alias(f"f_{n}") for n, c in names.items()])
    return _long(b.join(a, [*ids, "cycle_index"]))


def _long(wide: DataFrame) -> DataFrame:
    names = BIASES
    long = wide.select(*TRACE, "cycle_index", F.explode(F.array(*[F.struct(F.lit(n).alias("biomarker"), (F.col(f"f_{n}") - F.col(f"t_{n}")).alias("bias")) for n in names])).alias("b")).select(*TRACE, "cycle_index", "b.*")
    return long.where(~F.col("biomarker").isin("MC", "DA") | F.lower("vessel_type").startswith("a"))


def plateau_instability(bias_: DataFrame, by: list[str], tolerance: float = 0.5) -> DataFrame:
    """Share of cycles whose time of the largest value moved by more than the tolerance."""
    there = bias_.where("biomarker = 'tMAD' and bias is not null")
    return there.groupBy(*by).agg(F.avg((F.abs("bias") > tolerance).cast("int")).alias("instability"))


def triplets(table: DataFrame, by: list[str], value: str, floor: float = 0.05) -> DataFrame:
    """Three cycles of each segment, not under a share of the mean of the positive ones, divided by their mean, with their variation."""
    three = table.where(F.col("cycle_index") < 3).groupBy(*by).agg(*[F.max(F.when(F.col("cycle_index") == k, F.col(value))).alias(f"v{k}") for k in range(3)])
    three = three.where("v0 is not null and v1 is not null and v2 is not null and (v0 > 0 or v1 > 0 or v2 > 0)")
    vs = F.array("v0", "v1", "v2")
    good = F.filter(vs, lambda v: v > 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    three = three.withColumn("least", floor * total(good) / F.size(good)).withColumn("f", F.transform(vs, lambda v: F.greatest(v, F.col("least"))))
    three = three.withColumn("mean", total(F.col("f")) / 3).withColumn("m", F.transform("f", lambda v: v / F.col("mean")))
    cv = F.sqrt(total(F.transform("m", lambda v: (v - 1) * (v - 1))) / 2)
    return three.select(*by, F.col("mean").alias("mean_md"), *[F.col("m")[k].alias(f"m{k}") for k in range(3)], cv.alias("cv"))


def paired(table: DataFrame, by: list[str], cluster: str, a: str, b: str, absolute: bool = False) -> DataFrame:
    """Median difference a - b of each cluster, for the statistics below; pairs with a missing side are left out."""
    x, y = (F.abs(a), F.abs(b)) if absolute else (F.col(a), F.col(b))
    rows = table.withColumn("d", x - y).where("d is not null")
    return rows.groupBy(*by, cluster).agg(F.median("d").alias("d"), F.count("*").alias("n"))


def cluster_stats(medians: DataFrame, by: list[str], resamples: int = 5000, least: int = 3, seed: int = 0) -> DataFrame:
    """Median over clusters, its bootstrap interval and the signed-rank p of each group of ``paired`` rows; NULL for fewer than ``least``.

    Groups may have any number of clusters: ranks and places come from sums over sorted ranges (``ranking``)."""
    rows = written(medians.select(*by, "d", "n"), "medians")
    sizes = rows.groupBy(*by).agg(F.count("d").cast("int").alias("n_clusters"), F.sum("n").alias("n_samples"))
    ranks = R.signed_ranks(rows, by, "d")
    ranks = ranks.select(*by, R.signed_rank_p("n_all", "n", "w_plus", "ties").alias("p"))
    out = R.same(R.same(sizes, R.median_interval(rows, by, "d", resamples, seed).drop("size"), by, "left"), ranks, by, "left")
    return out.select(*by, "n_clusters", "n_samples", *[F.when(F.col("n_clusters") >= least, F.col(c)).alias(c) for c in ("median", "ci_low", "ci_high", "p")])


def paired_stats(table: DataFrame, by: list[str], a: str, b: str, least: int = 5, resamples: int = 5000, seed: int = 0) -> DataFrame:
    """Median of a - b over pairs, its bootstrap interval and the signed-rank p of each group; NULL for fewer than ``least`` pairs."""
    d = table.withColumn("d", F.col(a) - F.col(b)).where("d is not null").select(*by, "d", F.lit(1).cast("long").alias("n"))
    return cluster_stats(d, by, resamples, least, seed).drop("n_samples").withColumnRenamed("n_clusters", "n_pairs")


def compare_methods(table: DataFrame, value: str, cluster: str, families: dict[str, tuple[str, str, bool]], primary: tuple[str, ...], keys: list[str] | None = None, resamples: int = 5000) -> DataFrame:
    """Each family (two methods, and whether their absolute values are compared) by its clusters' medians; the primary ones adjusted by Holm.

    ``keys`` name the rows that two methods share; columns family, method_a, method_b, the statistics, p_holm (NULL outside the primary family)."""
    parts = []
    for family, (a, b, absolute) in families.items():
        own = [*(keys or KEY), *[k for k in (cluster,) if k not in (keys or KEY)]]
        x = table.where(F.col("method") == a).select(*own, F.col(value).alias("a"))
        y = table.where(F.col("method") == b).select(*own, F.col(value).alias("b"))
        parts.append(paired(x.join(y, own).withColumn("family", F.lit(family)), ["family"], cluster, "a", "b", absolute).withColumns({"method_a": F.lit(a), "method_b": F.lit(b)}))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    out = cluster_stats(both, ["family", "method_a", "method_b"], resamples)
    listed = F.col("family").isin(*primary) & F.col("p").isNotNull() & ~F.isnan("p")
    adjusted = holm(out.where(listed).withColumn("whole", F.lit(0)), "p", ["whole"]).select("family", "p_holm")
    return out.join(adjusted, "family", "left")


def noise_stationarity(traces: DataFrame, protocol: Protocol) -> DataFrame:
    """Deviation and lag-1 autocorrelation in baselines and recoveries of each series, and the ratio of the deviations, for a test against 1."""
    phase = F.when(protocol.in_phase(F.col("t"), "baseline"), "baseline").when(protocol.in_phase(F.col("t"), "recovery"), "recovery")
    parts = traces.withColumn("phase", phase).where("phase is not null")
    lag = autocorrelation(parts, [*KEY, "phase"]).groupBy(*KEY).pivot("phase", ["baseline", "recovery"]).agg(F.first("ac1"))
    sd = parts.groupBy(*KEY).pivot("phase", ["baseline", "recovery"]).agg(F.stddev_pop("y"))
    sd = sd.select(*KEY, F.col("recovery").alias("sd_recovery"), F.col("baseline").alias("sd_baseline"))
    out = sd.join(lag.select(*KEY, F.col("baseline").alias("ac1_baseline"), F.col("recovery").alias("ac1_recovery")), KEY, "left")
    return out.withColumn("ratio", F.when(F.col("sd_baseline") > 0, F.col("sd_recovery") / F.col("sd_baseline")))


def ratio_test(stationarity: DataFrame, cluster: str = "subject_id", resamples: int = 5000) -> DataFrame:
    """Clusters' median ratios against 1: their median difference, interval and p."""
    rows = stationarity.where("ratio is not null").withColumns({"whole": F.lit("all"), "one": F.lit(1.0)})
    return cluster_stats(paired(rows, ["whole"], cluster, "ratio", "one"), ["whole"], resamples).drop("whole")


def best_rows(df: DataFrame, n: int, value: str, *ties: str) -> DataFrame:
    """The n largest rows by value: a report, in one ordered take."""
    return df.orderBy(F.desc(value), *ties).limit(n)


def nearest_to_median(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """The row of each group whose value is nearest to the group's median."""
    mid = df.withColumn("mid", F.median(value).over(W.partitionBy(*by)))
    return mid.groupBy(*by).agg(F.min_by(F.struct(key, value), F.struct(F.abs(F.col(value) - F.col("mid")), F.col(key))).alias("r")).select(*by, "r.*")
