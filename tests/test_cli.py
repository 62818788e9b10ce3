"""Command line stages end to end on small folders."""

import json

from corpusforge.__main__ import main


def test_cli_stages(spark, tmp_path):
    src = tmp_path / "files" / "own" / "repo"
    src.mkdir(parents=True)
    (src / "a.py").write_text("import qiskit\n\n\ndef build(n):\n    \"\"\"Doc.\"\"\"\n    return n + 1\n")
    out = tmp_path / "out"
    main(["curate", "--files", str(tmp_path / "files"), "--out", str(out)])
    tasks = spark.read.json(str(out / "tasks")).collect()
    assert [r["entry_point"] for r in tasks] == ["build"]

    comp = tmp_path / "completions"
    for model, eid in (("GRPO", 0), ("ORPO", 1)):
        (comp / model).mkdir(parents=True)
        (comp / model / "part.json").write_text(json.dumps(
            {"task_id": "t/0", "generated_code": "qc = x", "reference": "ref"}) + "\n")
    meas = spark.createDataFrame(
        [("GRPO", "t/0", True, True, True, True, 0.5, 3, 4), ("ORPO", "t/0", False, False, False, True, None, None, None)],
        "model string, task_id string, has_circuit boolean, sv_ok boolean, counts_ok boolean, "
        "ref_ok boolean, fidelity double, depth int, gates int")
    meas.write.parquet(str(tmp_path / "meas"))
    main(["evaluate", "--completions", str(comp), "--measurements", str(tmp_path / "meas"), "--out", str(out)])
    main(["report", "--out", str(out)])
    summ = {r["model"]: r for r in spark.read.option("header", True).csv(str(out / "summary")).collect()}
    assert summ["GRPO"]["compile_rate"] == "1.0" and summ["ORPO"]["compile_rate"] == "0.0"
    rates = spark.read.option("header", True).csv(str(out / "rates_long")).count()
    assert rates == 4
