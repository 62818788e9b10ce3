"""The pipeline's stages on a small table with odd rows."""

import base64
import random
from collections import Counter

import brute
import corpus_pipeline as cp
import duckdb
from corpusforge.llm import quality
from corpusforge.llm.queries import MIX_SQL


def test_stages(spark, tmp_path):
    rng = range(40)
    rows = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(60)), "en", f"s{i % 3}", 10) for i in rng]
    rows += [(100, rows[3][1], "en", "s1", 5), (101, "", "en", None, 0), (102, None, None, "s2", None)]
    rows += [(200 + i, " ".join(f"x{j}###" for j in range(i + 5)), "en", "s0", 9) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in rng] + [(200 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES:
        step = stage(spark, step, str(tmp_path))
        if name != "tokenize":
            assert step.columns == docs.columns
        step = step.persist()
        seen.append(Counter(r.doc_id for r in step.collect()))
    good, near, cut, mixed, last = seen
    assert set(rng) <= set(good) and not [i for i in good if 200 <= i < 220]
    assert 3 in near and 100 not in near and set(near) <= set(good)
    assert cut == near and last == mixed
    assert set(mixed) <= set(near) and max(mixed.values()) <= 3
    again = Counter(r.doc_id for r in cp.run(spark, str(tmp_path)).collect())
    assert again == last


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated rows and copies without an id, through stages 2 and 3."""
    rng = random.Random(4)
    a, b, c, d, e, f = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(100)) for _ in range(6))
    rows = [(1, a), (1, a), (None, b), (None, b), (None, b), (5, c), (None, c), (None, d), (7, e), (7, f), (3, c), (9, None)]
    rows = [(i, x, "en", "s", x and len(x)) for i, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    near = cp.near_duplicates(spark, docs, str(tmp_path)).persist()
    want = Counter([(1, a), (None, b), (3, c), (None, d), (7, e), (7, f), (9, None)])
    assert near.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in near.collect()) == want
    cut = cp.repeated_passages(spark, near, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in cut) == want
    assert all(r.n_chars == (r.text and len(r.text)) for r in cut)


def test_run_matches_brute_force(spark, tmp_path):
    """run() against one row at a time; only the learned scores are taken over."""
    import public_tokenizers as P
    import tiktoken
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = [prose(120) for _ in range(3)]
    rows = []
    for i in range(60):
        text = prose(rng.choice([0, 2, 30, 90]))
        if i % 5 == 1:
            text = prose(20) + " " + shared[i % 3] + " " + prose(20)
        if i % 7 == 3 and rows:
            text = rows[-2][1] + rng.choice(["", " tail"])
        rows.append((i, text, "en", [None, "a", "b", "c"][i % 4], len(text)))
    rows += [(200 + i, "#### |<>| " * (9 + i), "en", "a", 9) for i in range(20)]
    rows += [(300, None, None, None, None), (301, "", "de", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in rows if r[0] < 300],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path)).collect()

    good = {r.doc_id for r in quality.quality(
        docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect()}
    kept = sorted(r for r in rows if r[0] in good)
    assert {r[0] for r in rows if r[0] < 200} <= good and not good & set(range(200, 220))
    group = brute.groups([brute.fingerprint(r[1]) for r in kept])
    single = [r for i, r in enumerate(kept) if group[i] == i]
    assert len(single) < len(kept)
    cut = []
    for r, gone in zip(single, brute.repeated([(r[1] or "").encode() for r in single], cp.PASSAGE_BYTES)):
        left, at = [], 0
        for c in r[1] or "":
            size = len(c.encode())
            if not any(gone[at:at + size]):
                left.append(c)
            at += size
        cut.append((r[0], "".join(left), *r[2:4], len(left)) if any(gone) else r)
    assert any(a != b for a, b in zip(cut, single))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", cut)
    copies = MIX_SQL.replace("::bigint * size)::bigint taken", "::bigint)::bigint taken")
    assert copies != MIX_SQL
    copies = {i: n for i, *_, n in con.execute(copies).fetchall()}
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, text, lang, source, n in cut:
        ids = tuple(own.encode_ordinary(text or ""))
        want[i, lang, source, n, len(ids), ids] += copies[i]
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, r.n_tokens, tuple(r.ids)) for r in got) == +want
