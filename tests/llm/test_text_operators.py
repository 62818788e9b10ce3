"""Operators on documents against brute force, with the odd rows of each kind."""

import base64
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import brute
from corpusforge.llm import bpe, mixing, quality, repeats, simhash, wordpiece

SCHEMA = "doc_id long, text string, source string"


def texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(1, 6))).strip() or "a" for _ in range(80)]
    out = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 40, 150]))) for _ in range(n)]
    for i in range(0, n - 8, 4):        # near copies, copies, shared passages
        out[i + 1] = out[i] + rng.choice(["", " x", " tail of it"])
        out[i + 2] = "pre " * 3 + out[i][5:]
    return out + ["", "   \n", "A b", "a B", "z" * 1200, "ab " * 500, "É" * 500, "É" * 500]


def rows(seed=1):
    t = texts(seed=seed)
    out = [(i, x, f"s{i % 3}" if i % 5 else None) for i, x in enumerate(t)]
    return out + [(500, None, "s1"), (None, "A b", "s0"), out[3], out[3], (3, "another text of an id", "s2")]


def test_simhash_brute_force(frame):
    data = rows()
    got = simhash.simhash_groups(frame(data, SCHEMA), "doc_id", "text").collect()

    fps = [brute.fingerprint(r[1]) for r in data]
    group = brute.groups(fps)
    low = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            low[group[i]] = min(low.get(group[i], r[0]), r[0])
    want = Counter((r[0], f"{fps[i]:016x}", low.get(group[i])) for i, r in enumerate(data))
    assert Counter(map(tuple, got)) == want


def test_simhash_cells_come_in_small_batches():
    """Cells are listed in Arrow batches; a link within the distance shares a cell
    that is one of the two fingerprints' own."""
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 64, 3 * simhash.BLOCK, np.uint64)
    fp[1::2] = fp[::2]
    for _ in range(3):                                   # up to three bits apart
        fp[1::2] ^= np.uint64(1) << rng.integers(0, 64, len(fp) // 2, np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], names=["fp"])
    out = list(simhash._cells(3)([batch.slice(0, 0), batch]))
    assert len(out) == 3 and max(b.num_rows for b in out) <= 34 * simhash.BLOCK
    stands = {}
    for b in out:
        for cell, f, up in zip(*(c.to_pylist() for c in b.columns)):
            stands.setdefault(f, {})[cell] = up
    for x, y in zip(fp[::2].view(np.int64).tolist(), fp[1::2].view(np.int64).tolist()):
        assert any(not (stands[x][c] and stands[y][c]) for c in stands[x].keys() & stands[y].keys())


@pytest.mark.parametrize("block", [2, 4096])
def test_simhash_links_all_near_pairs(spark, block):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0} | set(base)
    for b in base:
        for _ in range(30):
            x = b
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = [int(x) for x in np.array(sorted(fps), np.uint64).view(np.int64)]
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    for d in (0, 1, 2, 3, 5):
        edges = simhash.links(nodes, d, block).collect()
        lab = {x: x for x in fps}

        def find(x):
            while lab[x] != x:
                x = lab[x]
            return x

        def classes(pairs):
            lab.update({x: x for x in fps})
            for a, b in pairs:
                lab[find(a)] = find(b)
            return {frozenset(y for y in fps if find(y) == find(x)) for x in fps}
        near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= d]
        assert classes((e.u, e.v) for e in edges) == classes(near)


@pytest.mark.parametrize("group", [1, 8192])
def test_repeats_brute_force(frame, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    data, t = rows(2), 50
    got = repeats.remove_repeats(frame(data, SCHEMA), "doc_id", "text", t).collect()
    raw = [(r[1] or "").encode() for r in data]
    want = Counter((r[0], b, bytes(x for x, g in zip(b, gone) if not g))
                   for r, b, gone in zip(data, raw, brute.repeated(raw, t)))
    assert Counter((r.doc_id, bytes(r.text), bytes(r.kept)) for r in got) == want
    for r in got:
        assert all(a["e"] < b["s"] for a, b in zip(r.spans or [], (r.spans or [])[1:]))


def test_repeats_long_text_pieces(frame, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    rng = random.Random(3)
    part = "".join(rng.choices("abcdefgh", k=1000))
    data = [(1, "".join(rng.choices("abcdefgh", k=900)) + part + "x" * 7, None), (2, "q" * 3 + part[100:900], None)]
    got = {r.doc_id: [(s["s"], s["e"]) for s in r.spans] for r in
           repeats.remove_repeats(frame(data, SCHEMA), "doc_id", "text", 100).collect()}
    assert got == {1: [(1000, 1800)], 2: [(3, 803)]}


def test_repeated_rows_name_a_span_once(frame):
    """What goes into the window over an id's spans does not grow with its copies."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefgh", k=300))
    for own in (None, 1):
        df = repeats.repeated_spans(frame([(own, text, None)] * 40 + [(2, text[:200], None)], SCHEMA), "doc_id", "text", 50)
        assert sorted((r.id or 0, r.s, r.e) for r in df.collect()) == [(own or 0, 0, 300), (2, 0, 200)]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.rindex("Window"):]
        assert "Aggregate [id" in below[:below.index("Union")]


def test_cut_rows_keeps_characters_whole(spark):
    a, b = "é" * 60 + "one", "xé" + "é" * 59 + "é two"
    df = spark.createDataFrame([(1, a, "en", "s", 63), (2, b, None, None, 66), (3, None, "en", "s", None)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in repeats.cut_rows(df, "doc_id", "text", 101).collect()}
    assert out[3].text is None and out[3].n_chars is None
    for k in (1, 2):
        assert out[k].n_chars == len(out[k].text) and "�" not in out[k].text
    assert out[1].text == "one" and out[2].text == "x two"


def test_mix_targets_and_copies(frame):
    data = rows(3) + [(900 + i, "w " * (i % 40), "big") for i in range(400)]
    df = frame(data, SCHEMA)
    got = mixing.mix(df, "doc_id", "source", "text").collect()
    assert len(got) == len(data)
    size = Counter()
    words = [len((r[1] or "").encode().split()) for r in data]
    for r, w in zip(data, words):
        size[r[2]] += w
    names = sorted(size, key=lambda s: (s is None, s or ""))
    total, left, target = sum(words), dict.fromkeys(names), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    rest = total
    while True:         # share, cap, share the excess again
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            rest -= target[s]
            del left[s]
    target.update(share)
    by_size = {}
    for s in names:
        by_size.setdefault(size[s], set()).add(round(target[s], 6))
    taken = Counter()
    for r in got:
        assert round(r.target, 6) in by_size[r.source_size]
        assert 0 <= r.copies <= 3
        taken[r.source_size, round(r.target, 6)] += r.copies * r.size
    for (s, t), x in taken.items():
        assert abs(x - t) <= 400
    again = mixing.mix(df.repartition(5), "doc_id", "source", "text").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_bpe_matches_tiktoken(frame):
    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    odd = [chr(c) for c in range(0x300)] + list("'\u2028\u00a0\x85\x1c日本語९Ⅷ😀 sStTrevmlld")
    data = rows() + [(1000 + i, "".join(rng.choices(odd, k=50)), None) for i in range(200)]
    data += [(2000, "it's we'll  'S x'd'll \n 'r", None), (2001, "a" * 700000, None), (2002, "<|endoftext|>", None)]
    ids = bpe.encode(frame(data, SCHEMA), "doc_id", "text", path, P.PATTERN)
    got = Counter((r.doc_id, tuple(r.ids)) for r in ids.collect())
    assert got == Counter((r[0], tuple(own.encode_ordinary(r[1] or ""))) for r in data)
    back = Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode(ids, "doc_id", "ids", path).collect())
    assert back == Counter((r[0], (r[1] or "").encode()) for r in data)
    other = bpe.encode(frame(data[:20], SCHEMA), "doc_id", "text", path, r"\S+|\s+").collect()
    plain = tiktoken.Encoding("p", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    assert Counter((r.doc_id, tuple(r.ids)) for r in other) == Counter(
        (r[0], tuple(plain.encode_ordinary(r[1] or ""))) for r in data[:20])


def test_wordpiece_longest_match(frame):
    import public_tokenizers as P
    path = P.path("byte_bpe_50k.tiktoken")
    first, later = wordpiece.pieces_of(open(path, "rb").read())

    def brute(word, first=first, later=later):
        n, at, known = 0, 0, first
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in known), 0)
            if not end:
                return 1
            n, at, known = n + 1, end, later
        return n
    data = rows()
    got = Counter(map(tuple, wordpiece.token_counts(frame(data, SCHEMA), "doc_id", "text", path).collect()))
    split = [(r[1] or "").encode().split() for r in data]
    assert got == Counter((r[0], len(w), sum(map(brute, w))) for r, w in zip(data, split))
    rng = random.Random(5)
    for _ in range(200):
        f = {bytes(rng.choices(b"ab", k=rng.randint(1, 4))) for _ in range(5)}
        c = {bytes(rng.choices(b"ab", k=rng.randint(1, 4))) for _ in range(5)}
        auto = wordpiece.Automaton(f, c)
        for _ in range(30):
            w = bytes(rng.choices(b"ab", k=rng.randint(1, 9)))
            assert auto.count(w) == brute(w, f, c)


def test_quality_learns_and_ignores_held_out(frame, spark):
    rng = random.Random(7)
    data, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = ["".join(rng.choices("etaoin", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 400))]
        data.append((i, " ".join(w + "###" if bad else w for w in words), None))
        labels.append((i, 0 if bad else 1))
    data += [(1000, "", None), (1001, None, None), (None, "words", None), (1002, "fine words " * 20000, None)]
    frame_docs = frame(data, SCHEMA)
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(frame_docs, lab).collect()}
    assert len(got) == len(data)
    import zlib
    for i, y in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in labels if i in set(held)) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    # labels of held-out rows change nothing
    flip = spark.createDataFrame([(i, 1 - y if got[i].held_out else y) for i, y in labels], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality.quality(frame_docs, flip).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_quality_learns_from_each_id_once(frame, spark, monkeypatch):
    data = [(i, f"document {i} " * (i + 1), None) for i in range(40)]
    data += [(3, data[3][1], None)] * 50 + [(4, f"other text {i}", None) for i in range(50)] + [(6, "x" * 70, None)]
    ids = [i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5]
    assert {3, 4} <= set(ids)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", seen.extend)
    quality.train(frame(data, SCHEMA), labels, "doc_id", "text", "quality", max_bytes=10_000)
    assert sorted(y for _, y, _ in seen) == sorted(float(i % 2) for i in ids)
    assert all(w == 1 for _, _, w in seen)


def test_empty_tables(frame, spark):
    import public_tokenizers as P
    path = P.path("byte_bpe_50k.tiktoken")
    e = frame([], SCHEMA)
    assert simhash.simhash_groups(e, "doc_id", "text").count() == 0
    assert repeats.remove_repeats(e, "doc_id", "text").count() == 0
    assert mixing.mix(e, "doc_id", "source", "text").count() == 0
    assert bpe.decode(bpe.encode(e, "doc_id", "text", path, P.PATTERN), "doc_id", "ids", path).count() == 0
    assert wordpiece.token_counts(e, "doc_id", "text", path).count() == 0
    assert quality.quality(e, spark.createDataFrame([], "doc_id long, quality int")).count() == 0




def test_structured_text_does_not_tie_the_hashes(frame):
    """Blocks in the order of Thue-Morse digits and with the digits swapped: a
    polynomial modulo a power of two gives both the same value."""
    digits = [bin(i).count("1") % 2 for i in range(64)]
    tail = "".join(random.Random(0).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=144))
    pair = ["".join(("tgna", "flmo")[d ^ swap] for d in digits) + tail for swap in (0, 1)]
    got = repeats.remove_repeats(frame([(i, t, None) for i, t in enumerate(pair)], SCHEMA), "doc_id", "text", 400).collect()
    assert sorted((r.doc_id, r.spans, r.kept_text) for r in got) == [(0, None, pair[0]), (1, None, pair[1])]


def test_cut_rows_keeps_columns_of_any_name(spark):
    part = "".join(random.Random(6).choices("abcdefé", k=200))
    df = spark.createDataFrame([(1, "x" + part, 1, 2, 3, 4), (2, part + "y", 5, 6, 7, 8)],
                               "doc_id long, text string, _id2 int, _h2 int, _spans int, id int")
    got = sorted(map(tuple, repeats.cut_rows(df, "doc_id", "text", 100).collect()))
    assert got == [(1, "x", 1, 2, 3, 4), (2, "y", 5, 6, 7, 8)]
