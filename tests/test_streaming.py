"""Streaming scoring equals batch scoring on the same files."""

import json

from corpusforge.plans.score import score
from corpusforge.streaming.score_stream import (COMPLETION_TEXTS, completion_stream,
                                                start_scoring)


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "landing"
    src.mkdir()
    rows = [{"model": "GRPO", "task_id": "t/0",
             "text": "<reasoning>r</reasoning>\n<answer>import qiskit\ndef f(n):\n    return n</answer>"},
            {"model": "ORPO", "task_id": "t/1", "text": "no tags"}]
    for i, r in enumerate(rows):
        (src / f"part-{i}.json").write_text(json.dumps(r) + "\n")
    tasks = spark.createDataFrame([("t/0", "def f(n):\n    return n")], "task_id string, canonical_solution string")
    meas = spark.createDataFrame([("GRPO", "t/0", True, True, True, True, 0.81, 2, 3)],
                                 "model string, task_id string, has_circuit boolean, sv_ok boolean, "
                                 "counts_ok boolean, ref_ok boolean, fidelity double, depth int, gates int")
    out = str(tmp_path / "scored")
    q = start_scoring(completion_stream(spark, str(src)), tasks, meas, out,
                      checkpoint=str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out)
                 .select("model", "task_id", "r_format", "r_import", "r_run", "r_fidelity", "r_size").collect())
    batch = score(spark.read.schema(COMPLETION_TEXTS).json(str(src)), tasks, meas)
    want = sorted(tuple(r) for r in batch.select("model", "task_id", "r_format", "r_import",
                                                 "r_run", "r_fidelity", "r_size").collect())
    assert got == want
    assert got[0][4] == 1.5 and abs(got[0][5] - 1.8) < 1e-12
