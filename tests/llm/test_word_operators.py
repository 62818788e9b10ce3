"""Operators 11 to 13 against brute force, with the odd rows of each kind."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import brown, collocations, lexical

SCHEMA = "doc_id long, text string, lang string"


def documents(seed=1, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéÉABC1", k=rng.randint(1, 4))) for _ in range(40)]
    ends = [" ", "  ", "\t", "\n", ". ", ", ", "; ", "!", " ", "\x1c", "-"]

    def text():
        return "".join(rng.choice(words) + rng.choice(ends[:1] * 12 + ends) for _ in range(rng.choice([0, 1, 2, 30, 200])))
    out = [(i, text(), rng.choice(["en", "de", None])) for i in range(n)]
    return out + [(n, None, "en"), (n + 1, "", "de"), (n + 2, " \n\t ", None), (None, text(), "en"), (None, text(), None),
                  out[3], out[3], (3, text(), "en"), (n + 3, "x" * 5000, "en"), (n + 4, "ab cd " * 3000, "und")]


def found_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def best(docs, items, k):
    tf = [(i, Counter(found_terms(t))) for i, t, _ in docs]
    size = [sum(c.values()) for _, c in tf]
    n_docs, n_terms = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(tf, size):
            s = 0
            for t in set(found_terms(text)):
                if c[t]:
                    m = 50 + (50 * n * n_docs) // n_terms
                    s += (math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                          * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("cells, tile, k", [(1 << 22, 256, 7), (200, 3, 50), (1 << 22, 256, 400)])
def test_search_brute_force(frame, spark, monkeypatch, cells, tile, k):
    for name, value in (("CELLS", cells), ("DOCS", tile), ("CHUNK", 300 if tile == 3 else 4 << 20)):
        monkeypatch.setattr(lexical, name, value)
    docs = documents()
    items = [(i, t) for i, t, _ in documents(2, 12)]
    got = lexical.search(frame(docs, SCHEMA), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"),
                         "item_id", "text", k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == best(docs, items, k)


def test_search_sums_stay_exact():
    """Columns are cut so that no run's largest sum reaches 2**53."""
    import numpy as np
    bound = np.full(9000, 1 << 42, np.int64)
    runs = list(lexical._runs(bound))
    assert runs[0] == (0, 2047) and runs[-1][1] == 9000
    assert all(bound[a:b].sum() < 1 << 53 for a, b in runs) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))


def test_search_empty_tables(frame, spark):
    none, some = frame([], SCHEMA), frame([(1, "a b", None)], SCHEMA)
    for docs, items in ((none, some), (some, none), (frame([(1, "--", None)], SCHEMA), some)):
        assert lexical.search(docs, "doc_id", "text", items.toDF(*["item_id", *items.columns[1:]]), "item_id", "text").collect() == []


def phrases(docs, longest, least, share, k):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, longest + 1):
                f[lang].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in cand.items()):
                continue
            score, _, l, r = min((10 ** 6 * a * a // (count[p[:j]] * count[p[j:]]), j, count[p[:j]], count[p[j:]])
                                 for j in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:k])]
    return Counter(out)


@pytest.mark.parametrize("budget, chunk, longest, k", [(500_000, 4 << 20, 3, 2000), (20, 90, 3, 40), (60, 500, 4, 2000)])
def test_collocations_brute_force(frame, monkeypatch, budget, chunk, longest, k):
    """Small budgets list prefixes of one and more words; small chunks cut texts."""
    monkeypatch.setattr(collocations, "BUDGET", budget)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    docs = documents(3, 150)
    got = collocations.collocations(frame(docs, SCHEMA), "lang", "text", longest, 4, 50, k)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(docs, longest, 4, 50, k)
    assert len(want) > 20 and Counter(map(tuple, got.collect())) == want


def test_collocations_large_numbers_and_empty(frame, spark):
    assert collocations.collocations(frame([], SCHEMA), "lang", "text").collect() == []
    assert collocations.collocations(frame([(1, None, None), (2, "a, b", "en")], SCHEMA), "lang", "text").collect() == []


HELD = "coalesce(crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 = 2, false)"


def held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def test_move_takes_the_class_of_the_highest_likelihood():
    """Against moving the word in the text itself, and the matrix counted anew."""
    rng = random.Random(1)
    words = [rng.randrange(12) for _ in range(600)]
    pairs = list(zip(words, words[1:] + words[:1]))
    k, cls = 4, {w: w % 4 for w in range(12)}

    def bigrams(of):
        m = np.zeros((k, k))
        for a, b in pairs:
            m[of[a], of[b]] += 1
        return m
    m = bigrams(cls)
    for w in range(12):
        left, right = np.zeros(k), np.zeros(k)
        for a, b in pairs:
            if b == w:
                left[cls[a]] += 1
            if a == w:
                right[cls[b]] += 1
        double = sum(a == b == w for a, b in pairs)
        want = max(range(k), key=lambda h: brown.likelihood(bigrams(cls | {w: h})))
        got = brown.move(m, k, cls[w], left, right, double)
        assert brown.likelihood(bigrams(cls | {w: got})) == pytest.approx(brown.likelihood(bigrams(cls | {w: want})))
        cls[w] = got
        assert np.array_equal(m, bigrams(cls))


@pytest.mark.parametrize("block, chunk, frequent", [(12 << 20, 1 << 20, 8192), (700, 90, 6)])
def test_class_model_brute_force(frame, monkeypatch, block, chunk, frequent):
    """The learned classes are taken over; counts, bigrams and sums are plain loops."""
    monkeypatch.setattr(brown, "BLOCK", block)
    monkeypatch.setattr(brown, "CHUNK", chunk)
    monkeypatch.setattr(brown, "STEP", chunk)
    docs, stats = documents(5), []
    got = brown.score(frame(docs, SCHEMA), "doc_id", "text", F.expr(HELD), classes=5, frequent=frequent, sweeps=4, stats=stats)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    model, _ = stats[0]
    assert model.likelihood[0] == min(model.likelihood) and max(model.likelihood) > model.likelihood[0]
    toks = [((t or "").encode().lower().split() + [None], held_out(i)) for i, t, _ in docs]
    c = Counter(w for ts, held in toks if not held for w in ts)
    words = {bytes(r.word) or None: (r.c, r.cls) for r in model.words.collect()}
    assert {w: n for w, (n, _) in words.items()} == dict(c) and words[None][1] == 6
    n, unknown = sum(c.values()), 7
    cls = lambda w: words[w][1] if w in words else unknown
    m = np.zeros((8, 8))
    for ts, held in toks:
        for a, b in zip([None] + ts, ts):
            if not held:
                m[cls(a), cls(b)] += 1
                if c[b] == 1:
                    m[cls(a), unknown] += 1
                if c[a] == 1:
                    m[unknown, cls(b)] += 1
    assert np.array_equal(m, model.bigrams)
    size = np.zeros(8)
    size[unknown] = 1 + sum(x == 1 for x in c.values())
    for w, x in c.items():
        size[cls(w)] += x + 1

    def p(a, b):
        step = (m[cls(a), cls(b)] + 10 * size[cls(b)] / size.sum()) / (m[cls(a)].sum() + 10)
        return step * ((c[b] + 1) / size[cls(b)] if b in c else 1)
    for a in (None, *list(c)[:5], b"never seen"):
        assert sum(p(a, b) for b in (*c, b"another word")) == pytest.approx(1)

    def summary(r):
        return (r[0], *r[1:5], *(round(x, 6) for x in r[5:]))
    want = [(i, held, len(ts), sum(w in c for w in ts), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ts),
             sum(math.log10(p(a, b)) for a, b in zip([None] + ts, ts))) for (i, _, _), (ts, held) in zip(docs, toks)]
    assert Counter(map(summary, rows)) == Counter(map(summary, want))


def test_class_model_rows_are_small(frame, spark):
    """A block is one row in every table: 8 MB of text make two, and the known words
    of a block are lists of numbers."""
    key, made = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key, None)
    docs = [(i, f"w{i} alpha beta gamma " * 40_000, None) for i in range(10)]
    blocks = brown.encode(frame(docs, SCHEMA).coalesce(1), "doc_id", "text", F.lit(False), made)
    assert blocks.count() == 2
    known = brown.lookup(blocks, brown.train(blocks, 3, 8, 2), made)
    assert dict(known.dtypes) == {"block": "bigint", "place": "array<bigint>", "c": "array<bigint>"}
    assert sorted(len(r.place) for r in known.collect()) == sorted(len(r.words) for r in blocks.collect())
    for name in made:
        spark.sql(f"DROP TABLE {name}")
    assert spark.conf.get(key, None) == before


def test_rare_words_over_batches_are_one():
    """Counts of one word that batches cut are added up, whatever the batches are."""
    class Shared:
        value = np.random.default_rng(1).integers(0, 50, (5, 5))
    rng = random.Random(2)
    rows = sorted((b"w%d" % rng.randrange(30), [(rng.randrange(10), rng.randrange(1, 90)) for _ in range(rng.randrange(1, 4))])
                  for _ in range(200))
    table = pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in rows], pa.binary()), pa.array([np.array(v, brown._PAIR).tobytes() for _, v in rows], pa.binary())],
        names=["word", "v"])

    def moved(size):
        cuts = [table.slice(i, size) for i in range(0, len(rows), size)]
        return [tuple(r.values()) for b in brown._rare_moves(Shared, 3)([table.slice(0, 0), *cuts]) for r in b.to_pylist()]
    want = Counter()
    for w, v in rows:
        want[w] += sum(n for at, n in v if at >= 5)
    for size in (1, 7, 64, 200):
        assert moved(size) == moved(200)
    assert {w: c for w, c, _ in moved(7)} == dict(want) and len(moved(1)) == len({w for w, _ in rows})


def test_class_model_without_training_texts(frame):
    docs = [(i, "a b", None) for i in range(40) if held_out(i)]
    for data in ([], docs):
        got = brown.score(frame(data, SCHEMA), "doc_id", "text", F.expr(HELD), classes=3, sweeps=2).collect()
        assert sorted(map(tuple, got)) == [(i, True, 3, 0, 0, 0.0, 0.0) for i, _, _ in data]
