"""Quality of segments: missing cells, gaps of whole frames, baseline noise, flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import observed, statistic
from ..functions.protocol import Protocol, Window
from ..sources.cells import KEY
from .sequences import runs


@dataclass(frozen=True)
class Thresholds:
    """Shares of missing cells, lengths of gaps in frames, fewest loci and baseline samples."""

    missing_total: float = 0.50
    missing_flicker: float = 0.67
    small: int = 5
    medium: int = 10
    large: int = 25
    min_loci: int = 10
    min_baseline: int = 10


def gap_runs(cells: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Runs of frames in which no locus is observed: start, end and class; shorter ones than small are left out."""
    frames = cells.groupBy(*KEY, "t_idx").agg(F.max("m").alias("any"))
    found = runs(frames, ~F.col("any"), KEY)
    kind = F.when(F.col("length") >= t.large, "large").when(F.col("length") >= t.medium, "medium").when(F.col("length") >= t.small, "small")
    return found.withColumn("kind", kind).where("kind is not null")


def report(cells: DataFrame, protocol: Protocol, t: Thresholds = Thresholds(), mode: str = "mean") -> DataFrame:
    """One row a segment. Those with too few loci have only their size and that flag."""
    missing = lambda w: 1 - F.avg(F.when(w.holds(F.col("t")), F.col("m").cast("int")))
    name = lambda k, w: "missing_global_baseline" if k < 0 else f"missing_cycle{k}_{w.phase}"
    windows = [(name(k, w), w) for k, w in protocol.windows() if not (k < 0 and w is protocol.end_baseline)]
    flicker = [n for n, w in windows if w.phase == "flicker"]
    size = cells.groupBy(*KEY, "vessel_type").agg(F.count_distinct("locus").alias("n_loci"), F.count_distinct("t_idx").alias("n_times"), (1 - F.avg(F.col("m").cast("int"))).alias("missing_total"), *[missing(w).alias(n) for n, w in windows])
    gaps = gap_runs(cells, t).groupBy(*KEY).agg(*[F.count_if(F.col("kind") == k).alias(f"gaps_{k}") for k in ("small", "medium", "large")], F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gaps"))
    rest = protocol.global_baseline or Window("baseline", 0, 20)
    trace = cells.where(rest.holds_frame(F.col("t_idx"), protocol.fs)).groupBy(*KEY, "t_idx").agg(statistic(observed(F.col("x"), F.col("m")), mode).alias("y"))
    noise = trace.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("y").alias("baseline_mean"), F.stddev_pop("y").alias("baseline_std")).where(F.col("n") >= t.min_baseline).drop("n")
    out = size.join(gaps, KEY, "left").join(noise, KEY, "left")
    held = [F.col(n) for n in flicker]
    there = sum((c.isNotNull().cast("int") for c in held), F.lit(0))
    few = F.col("n_loci") < t.min_loci
    out = out.withColumns({f"gaps_{k}": F.coalesce(f"gaps_{k}", F.lit(0)) for k in ("small", "medium", "large")})
    out = out.withColumns(
        {
            "missing_flicker": F.when(there > 0, sum((F.coalesce(c, F.lit(0.0)) for c in held), F.lit(0.0)) / there),
            "baseline_snr_db": F.when((F.col("baseline_std") > 0), 20 * F.log10(F.abs("baseline_mean") / F.col("baseline_std"))),
            "flag_too_few_loci": few,
        }
    )
    flags = {"flag_missing_total": F.coalesce(F.col("missing_total") > t.missing_total, F.lit(False)), "flag_missing_flicker": F.coalesce(F.col("missing_flicker") > t.missing_flicker, F.lit(False)), "flag_large_gaps": F.col("gaps_large") > 0}
    measured = ["missing_total", *[n for n, _ in windows], "missing_flicker", "gaps_small", "gaps_medium", "gaps_large", "gaps", "baseline_mean", "baseline_std", "baseline_snr_db"]
    out = out.withColumns({n: F.when(~few, c) for n, c in flags.items()})
    out = out.withColumns({n: F.when(~few, F.col(n)) for n in measured})
    failed = F.col("flag_too_few_loci") | F.coalesce("flag_missing_total", F.lit(False)) | F.coalesce("flag_missing_flicker", F.lit(False)) | F.coalesce("flag_large_gaps", F.lit(False))
    return out.withColumn("passed", ~failed)


def by_recording(report_: DataFrame) -> DataFrame:
    """One row a recording: its segments, those that passed, those with too few loci, and the mean and largest share of missing cells."""
    counts = [F.count("*").alias("n_segments"), F.count_if("passed").alias("n_passed"), F.count_if("flag_too_few_loci").alias("n_too_few_loci")]
    return report_.groupBy("subject_id", "visit_id").agg(*counts, F.avg("missing_total").alias("missing_mean"), F.max("missing_total").alias("missing_max"))


def flat(report_: DataFrame, run_name: str, stage: str = "raw", scope: str = "dataset") -> DataFrame:
    """The report with nested values as JSON text and the run's name, stage and scope, for flat files."""
    return report_.withColumns({"gaps": F.to_json("gaps"), "run_name": F.lit(run_name), "stage": F.lit(stage), "scope": F.lit(scope)})
