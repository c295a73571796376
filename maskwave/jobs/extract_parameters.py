"""Job: from a folder of exports to parameter tables (and traces) of several preprocessors, part by part.

    python -m maskwave.jobs.extract_parameters --data hdfs:///exports --out hdfs:///results --methods rpca,kotliar --segments A1,V3 --traces
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..functions.protocol import Protocol, standard
from ..operators import biomarkers as B
from ..operators import evaluation as E
from ..sources import exports as X
from ..sources import sinks
from .ledger import Ledger


def extract_parameters(
    spark: SparkSession, data: str, out: str, protocol: Protocol, methods: tuple[str, ...] = ("rpca",), definitions=B.PAPER_SET,
    segments: tuple[str, ...] = (), traces: bool = False, parts: int = 8, form: type[X.ExportFormat] = X.ExportFormat, options: dict[str, dict] | None = None, **reading,
) -> dict[str, int]:
    """Does the recordings under ``data`` that ``out`` lacks; how many parts were written, by method.

    Files that cannot be read and segments that a method cannot do are failed rows of the table, not the end of the job."""
    X.register(spark, form)
    read = {"segments": ",".join(segments), "mode": "PERMISSIVE", **{k: str(v) for k, v in reading.items()}}
    recordings = X.listed(spark, data, form, segments=read["segments"])
    ledger, written = Ledger(spark, out), {}
    for method in methods:

        def work(chosen: str, method: str = method):
            cells = spark.read.format(form.name).options(**X.options(protocol, recordings=chosen, **read)).load(data)
            found = E.preprocess(cells, protocol, method, **(options or {}).get(method, {}))
            tables = {"parameters": B.extract(found, protocol, definitions)}
            return tables | ({"traces": found} if traces else {})

        written[method] = ledger.advance(recordings, method, work, parts)
    return written


def main(given: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--methods", default="rpca")
    p.add_argument("--segments", default="")
    p.add_argument("--fs", type=float, default=25.0)
    p.add_argument("--parts", type=int, default=8)
    p.add_argument("--traces", action="store_true")
    p.add_argument("--csv", help="a folder for the whole parameter table as CSV")
    a = p.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    names = lambda text: tuple(n for n in text.split(",") if n)
    done = extract_parameters(spark, a.data, a.out, standard(a.fs), names(a.methods), segments=names(a.segments), traces=a.traces, parts=a.parts)
    table = Ledger(spark, a.out).table("parameters")
    if a.csv and table is not None:
        sinks.write_csv(table, a.csv)
    print(" ".join(f"{m}: {n} parts written" for m, n in done.items()))


if __name__ == "__main__":
    main()
