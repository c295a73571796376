"""Job: evaluation of preprocessors on hybrids of a folder's recordings, part by part, and its summaries by vessel and method.

    python -m maskwave.jobs.hybrid_experiments --data hdfs:///exports --out hdfs:///hybrids --configs 10
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.protocol import Protocol, standard
from ..operators import aggregates as A
from ..operators import denoise as N
from ..operators import evaluation as E
from ..operators import hybrid as H
from ..sources import exports as X
from .ledger import Ledger

MEASURES = ("sdr", "nmse", "delta_sdr", "instability")


def hybrid_experiments(spark: SparkSession, data: str, out: str, protocol: Protocol, methods=tuple(E.METHODS), configs: int = 10, config: N.RpcaConfig = N.RpcaConfig(), support: float = 0.75, parts: int = 8, form: type[X.ExportFormat] = X.ExportFormat, **reading) -> int:
    """Evaluates the recordings under ``data`` that ``out`` lacks; returns how many parts were written. Unreadable files are left out."""
    X.register(spark, form)
    read = {"mode": "DROPMALFORMED", **{k: str(v) for k, v in reading.items()}}

    def work(chosen: str):
        cells = spark.read.format(form.name).options(**X.options(protocol, recordings=chosen, **read)).load(data).drop("units", "path", "error")
        return {"hybrids": E.evaluate(H.build(cells, protocol, configs), protocol, methods, support, config)}

    return Ledger(spark, out).advance(X.listed(spark, data, form), "hybrid", work, parts)


def summary(rows: DataFrame, protocol: Protocol) -> DataFrame:
    """vessel_type (and all), method, measure, median, median_abs, n of the evaluation's measures and of its biases over all cycles."""
    biases = {c.split("_")[1] for c in rows.columns if c.startswith("bias_")}
    each = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]
    each += [F.struct(F.lit(f"bias_{b}").alias("measure"), F.col(f"bias_{b}_c{c.index}").alias("value")) for b in sorted(biases) for c in protocol.cycles]
    kind = F.when(F.substring("segment_label", 1, 1) == "A", "artery").otherwise("vein")
    long = rows.select(kind.alias("vessel_type"), F.explode(F.array(*each)).alias("e"), "method").select("vessel_type", F.concat_ws("|", "method", "e.measure").alias("of"), "e.value")
    out = A.summary_with_all(long, "vessel_type", "of", "value")
    name = F.split("of", "\\|")
    return out.select("vessel_type", name[0].alias("method"), name[1].alias("measure"), "median", "median_abs", "n")


def main(given: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--configs", type=int, default=10)
    p.add_argument("--fs", type=float, default=25.0)
    p.add_argument("--parts", type=int, default=8)
    a = p.parse_args(given)
    spark, protocol = SparkSession.builder.getOrCreate(), standard(a.fs)
    n = hybrid_experiments(spark, a.data, a.out, protocol, configs=a.configs, parts=a.parts)
    rows = Ledger(spark, a.out).table("hybrids")
    if rows is not None:
        summary(rows, protocol).write.mode("overwrite").parquet(f"{a.out}/summary")
    print(f"{n} parts written")


if __name__ == "__main__":
    main()
