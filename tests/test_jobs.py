"""Jobs run over what is new alone, go on after a break, and never read what a broken run left."""

import numpy as np
import pytest

from maskwave.functions.protocol import standard
from maskwave.jobs import extract_parameters as J
from maskwave.jobs import hybrid_experiments as HE
from maskwave.jobs.ledger import Ledger
from maskwave.operators import biomarkers as B
from maskwave.operators import denoise as N
from maskwave.operators import evaluation as E

P = standard(2.0)


def put(folder, *names):
    for k, name in enumerate(names):
        x = 100 + np.random.default_rng(k).normal(0, 1, (640, 5))
        (folder / name).write_text("\n".join("\t".join(f"{v:.3f}" for v in row) for row in x) + "\n")


def test_parameters_are_extracted_once_and_go_on_after_a_break(spark, tmp_path, monkeypatch):
    data, out = tmp_path / "data", str(tmp_path / "out")
    data.mkdir()
    put(data, *(f"s{k}_0_A1.txt" for k in range(6)), "s0_0_V3.txt")
    (data / "s9_0_A1.txt").write_text("nothing")
    run = lambda **more: J.extract_parameters(spark, str(data), out, P, ("kotliar", "gherghel"), B.DEFAULT_SET, parts=3, **more)

    ledger, calls, real = Ledger(spark, out), [], E.preprocess

    def breaking(*args, **more):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*args, **more)

    monkeypatch.setattr(E, "preprocess", breaking)
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.setattr(E, "preprocess", real)
    before = ledger.table("parameters").count()
    assert ledger.done().select("part").distinct().count() == 2 and 0 < before < 7 * 3
    spark.range(3).write.parquet(f"{out}/parameters/part=left-by-a-broken-run")  # never read
    again = run()
    assert again["gherghel"] == 3 and 1 <= again["kotliar"] <= 2
    table = ledger.table("parameters")
    assert table.count() == 2 * 8 * 3 and table.select("subject_id", "segment_label", "method", "cycle_index").distinct().count() == 48
    assert {(r["subject_id"], r["error_stage"]) for r in table.where("not ok").collect()} == {("s9", "read")}
    stamp = {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("out/parameters/**/*.parquet")}
    assert run() == {"kotliar": 0, "gherghel": 0} and stamp == {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("out/parameters/**/*.parquet")}
    put(data, "t1_0_A1.txt")
    assert run() == {"kotliar": 1, "gherghel": 1} and ledger.table("parameters").count() == 54


def test_the_command_line(spark, tmp_path, capsys):
    data = tmp_path / "data"
    data.mkdir()
    put(data, "s1_0_A1.txt", "s2_0_V3.txt")
    J.main(["--data", str(data), "--out", str(tmp_path / "o"), "--methods", "kotliar", "--segments", "A1", "--fs", "2", "--traces", "--csv", str(tmp_path / "csv")])
    assert capsys.readouterr().out.strip() == "kotliar: 1 parts written"
    ledger = Ledger(spark, str(tmp_path / "o"))
    assert ledger.table("traces").count() == 640 and ledger.table("parameters").count() == 3 and ledger.table("none") is None
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_hybrids_and_their_summary(spark, tmp_path):
    data, out = tmp_path / "data", str(tmp_path / "out")
    data.mkdir()
    put(data, "s1_0_A1.txt", "s2_0_V3.txt")
    (data / "s3_0_A1.txt").write_text("nothing")
    run = lambda: HE.hybrid_experiments(spark, str(data), out, P, ("sms",), configs=1, config=N.RpcaConfig(support_frac=0.6), support=0.6, parts=1)
    assert run() == 1 and run() == 0
    rows = Ledger(spark, out).table("hybrids")
    assert rows.count() == 2
    told = {(r["vessel_type"], r["measure"]): r for r in HE.summary(rows, P).collect()}
    assert told["all", "sdr"]["n"] == 2 and told["artery", "bias_MD"]["n"] <= 3 and ("vein", "bias_tMAD") in told
