"""Listing rules, names, scans and write/read round trips."""

import json
import os

from pyspark.sql import functions as F

from corpusforge.sources import readers as rd
from corpusforge.sources import writers as wr
from corpusforge.sources.schemas import SEARCH_PAGES


def _item(i):
    return {"path": f"p{i}.py", "repository": {"full_name": f"o/r{i}", "default_branch": "main"}}


def _pages(spark, pages):
    return spark.createDataFrame(pages, SEARCH_PAGES)


def test_listing_stops(spark):
    full = [_item(i) for i in range(3)]
    # per_page 3: page 2 is short -> page 3 never read
    p = _pages(spark, [(1, 200, full), (2, 200, full[:2]), (3, 200, full)])
    assert rd.listing(p, max_files=100, per_page=3).count() == 5
    # failed page 2 -> only page 1
    p = _pages(spark, [(1, 200, full), (2, 403, full), (3, 200, full)])
    assert rd.listing(p, max_files=100, per_page=3).count() == 3
    # missing page 2, empty page
    p = _pages(spark, [(1, 200, full), (3, 200, full)])
    assert rd.listing(p, max_files=100, per_page=3).count() == 3
    p = _pages(spark, [(1, 200, full), (2, 200, []), (3, 200, full)])
    assert rd.listing(p, max_files=100, per_page=3).count() == 3
    # the cap keeps the first items in page order
    p = _pages(spark, [(2, 200, full), (1, 200, full), (3, 200, full[:1])])
    rows = rd.listing(p, max_files=4, per_page=3).orderBy("page", "pos").collect()
    assert [(r["page"], r["pos"]) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert rd.listing(_pages(spark, [(2, 200, full)]), 10, 3).count() == 0


def test_raw_url_and_flat_name(spark):
    df = spark.createDataFrame([("a_b", "c/d.py", "dev"), ("a", "b_c", "main")],
                               "repo string, path string, branch string")
    rows = df.select(rd.raw_url().alias("u"), rd.flat_name().alias("f")).collect()
    assert rows[0]["u"] == "https://raw.githubusercontent.com/a_b/dev/c/d.py"
    assert rows[0]["f"] == "a_b__c_d.py"
    assert rows[1]["f"] == "a__b_c.py"


def test_scan_files(spark, tmp_path):
    root = tmp_path / "files"
    (root / "own" / "repo" / "pkg").mkdir(parents=True)
    (root / "own" / "repo" / "pkg" / "m.py").write_bytes(b"def f():\r\n    return 1\r\n")
    (root / "own" / "repo" / "bad.py").write_bytes(b"x = '\xff'\n")
    (root / "own" / "repo" / "note.txt").write_bytes(b"skip")
    rows = rd.read_source_files(spark, str(root)).collect()
    assert [(r["repo"], r["path"], r["content"]) for r in rows] == \
           [("own/repo", "pkg/m.py", "def f():\n    return 1\n")]


def test_csv_round_trip(spark, tmp_path):
    vals = ["  lead", "trail  ", "a\\", 'say "x", ok', "l1\r\nl2", "l1\nl2", "a\tb", "", None]
    df = spark.createDataFrame([(str(i), v, "r") for i, v in enumerate(vals)],
                               "prompt string, chosen string, rejected string")
    path = str(tmp_path / "prefs")
    wr.write_preferences_csv(df, path)
    back = {r["prompt"]: r["chosen"] for r in rd.read_preferences_csv(spark, path).collect()}
    assert back == {str(i): v for i, v in enumerate(vals)}


def test_json_tasks_round_trip_and_array_file(spark, tmp_path):
    rows = [("t/0", "# d\n\n# Implement `f` below.", "def f():\n    pass", "f", "basic")]
    df = spark.createDataFrame(rows, "task_id string, prompt string, canonical_solution string, "
                                     "entry_point string, difficulty_scale string")
    path = str(tmp_path / "tasks")
    wr.write_tasks_json(df, path)
    assert [tuple(r) for r in rd.read_tasks_json(spark, path).collect()] == rows
    arr = tmp_path / "tasks.json"
    arr.write_text(json.dumps([dict(zip(df.columns, rows[0]))], indent=4))
    assert [tuple(r) for r in rd.read_tasks_json(spark, str(arr), multiline=True).collect()] == rows


def test_completions_array_with_bad_entry(spark, tmp_path):
    p = tmp_path / "grpo.json"
    p.write_text(json.dumps([{"task_id": "t/1", "generated_code": "x"}, "oops",
                             {"task_id": "t/2", "completion": "y", "reference": ""}], indent=2))
    df = rd.read_completions(spark, str(p), multiline=True)
    from corpusforge.operators.evaluate import split_bad_rows
    good, bad = split_bad_rows(df, F.col("_corrupt_record").isNotNull())
    assert sorted(r["task_id"] for r in good.collect()) == ["t/1", "t/2"]


def test_summary_and_missing_detail(spark, tmp_path):
    s = spark.createDataFrame([("A", 0.5, 0.25, None, 2.5, 4)],
                              "model string, compile_rate double, sim_rate double, "
                              "mean_fidelity double, median_depth double, count long")
    path = str(tmp_path / "summary")
    wr.write_summary_csv(s, path)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
    assert [tuple(r) for r in rd.read_summary_csv(spark, path).collect()] == [tuple(s.first())]
    assert rd.read_outcomes_csv(spark, str(tmp_path / "absent")) is None


def test_search_pages_from_saved_json(spark, tmp_path):
    pages = [{"page": 1, "status": 200, "items": [_item(0), _item(1)]},
             {"page": 2, "items": [_item(2)]},                       # status absent: a saved 200
             {"page": 3, "status": 200, "items": [_item(3)]}]        # after a short page: unread
    path = tmp_path / "pages.jsonl"
    path.write_text("\n".join(json.dumps(p) for p in pages) + "\n")
    items = rd.listing(rd.read_search_pages(spark, str(path)), max_files=10, per_page=2)
    rows = items.select("page", "pos", "repo", rd.raw_url().alias("url")).orderBy("page", "pos").collect()
    assert [(r["page"], r["pos"]) for r in rows] == [(1, 0), (1, 1), (2, 0)]
    assert rows[2]["url"] == "https://raw.githubusercontent.com/o/r2/main/p2.py"


def test_array_of_many_splits(spark, tmp_path):
    """One file over many splits, with braces, quotes and escapes in strings,
    nested values and elements that are no objects."""
    rows = [{"id": i, "s": ['a}b{', 'q"uo]te', "back\\\\", 'x\\"}', "}" * 40, "l\n},{"][i % 5] * (1 + i % 3),
             "n": {"k": [{"z": i}, [i]]}} for i in range(60)]
    mixed = rows[:20] + ["oops }", 7, None] + rows[20:] + ["last}"]
    path = tmp_path / "big.json"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        for indent in (None, 4):
            path.write_text(json.dumps(mixed, indent=indent))
            out = rd.read_array_elements(spark, str(path)).collect()
            assert not [r for r in out if r["bad"]]
            objects = sorted((r["pos"], r["element"]) for r in out if (r["element"] or "").startswith("{"))
            assert [json.loads(e) for _, e in objects] == rows
            assert sorted(r["element"] or "" for r in out if not (r["element"] or "").startswith("{")) == \
                sorted(["oops }", "7", "", "last}"])
        text = json.dumps(rows)
        for cut in (len(text) - 1, len(text) // 2, text.index("}}", 900) + 2):  # cut behind and within an element
            path.write_text(text[:cut])
            out = rd.read_array_elements(spark, str(path)).collect()
            good = [json.loads(r["element"]) for r in sorted((r for r in out if r["element"]), key=lambda r: r["pos"])]
            whole = next(n for n in range(60, -1, -1) if text[:cut].startswith(json.dumps(rows[:n])[:-1]))
            assert good == rows[:whole]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_array_edges_and_written_array(spark, tmp_path):
    for i, (text, good, bad) in enumerate([("[]", 0, 0), ("", 0, 0), (" [ ]\n", 0, 0), ('{"a": 1}', 0, 1),
                                           ('["x", 2]', 2, 0), ('[{"a": 1}, {bad}, {"b": 2}]', 2, 1)]):
        f = tmp_path / f"e{i}.json"
        f.write_text(text)
        out = rd.read_array_elements(spark, str(f)).collect()
        assert (sum(r["element"] is not None for r in out), sum(r["bad"] is not None for r in out)) == (good, bad), text
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t}}{i}\n") for i in range(50)], "id long, t string")
    path = str(tmp_path / "arr")
    wr.write_array(df, path, ["id"])
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    joined = "".join(open(os.path.join(path, f)).read() for f in parts)
    assert json.loads(joined) == [{"id": r["id"], "t": r["t"]} for r in df.orderBy("id").collect()]
    back = rd.read_array_elements(spark, path, parts=True).collect()
    assert len(parts) > 1 and sorted(json.loads(r["element"])["id"] for r in back) == list(range(50))
    wr.write_array(df.limit(0), path, ["id"])
    assert rd.read_array_elements(spark, path, parts=True).count() == 0
