"""Quality classifier: attention-based multiple-instance learning (operator 1).

A document is a bag of passages of ``PASSAGE`` bytes. A passage is described by
the shares of its byte-class pairs, how many of its word beginnings are
distinct, and its fill; a dense tanh layer encodes it. Gated attention gives
each passage a weight, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, and the
weighted sum of the encodings is scored by a logistic unit. Encoder, attention
and score are learned together from document labels.

Training takes at most ``per_class`` documents of each label (those of smallest
id hash, each of at most ``max_bytes`` bytes), weighted back to the label
shares of all labelled rows; that bounds what reaches the driver. Scoring reads
every byte of every text, in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import chunks, cut, ready, slices

PASSAGE = 512
PIECE = 1 << 19         # bytes of one text described at a time, a multiple of PASSAGE
CHUNK = 1 << 19
KINDS = 14
FEATURES = KINDS * KINDS + 2
PER_CLASS = 2000
MAX_BYTES = 1 << 16

_KIND = np.full(256, 13, np.uint8)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\t\n\x0b\x0c\r", b".,;:",
                           b"!?", b"'\"-()", b"#", b"&", b"$%*@", b"|<>{}[]=\\/^~`+_", range(0xC0, 256))):
    _KIND[list(_set)] = _k


def _pieces(texts):
    """``(row, bytes, own bytes)``: a piece and the byte after it, if any."""
    for row, b in enumerate(texts):
        for a in range(0, max(len(b), 1), PIECE):
            yield row, b[a:a + PIECE + 1], min(PIECE, len(b) - a)


def _describe(pieces):
    """Rows and features of all passages of the pieces (an empty text has one)."""
    rows, parts, own = zip(*pieces)
    size = np.array([len(p) for p in parts])
    own = np.array(own)
    off = np.cumsum(size) - size
    n_pass = np.maximum(1, -(-own // PASSAGE))
    first = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    row = np.repeat(np.array(rows), n_pass)
    buf = np.frombuffer(b"".join(parts), np.uint8)
    x = np.zeros((total, FEATURES), np.float32)
    if not len(buf):
        return row, x
    within = np.arange(len(buf)) - np.repeat(off, size)
    mine = within < np.repeat(own, size)
    passage = np.repeat(first, size) + within // PASSAGE
    length = np.bincount(passage[mine], minlength=total)
    kind = _KIND[buf].astype(np.int64)
    nxt = np.r_[within[1:] > 0, False]          # the next byte belongs to the same piece
    pair = np.flatnonzero(mine & nxt)
    counts = np.bincount(passage[pair] * (KINDS * KINDS) + kind[pair] * KINDS + kind[pair + 1],
                         minlength=total * KINDS * KINDS).reshape(total, -1)
    x[:, :-2] = counts / np.maximum(length, 1)[:, None]
    space = (kind == 3) | (kind == 4)
    start = np.flatnonzero(mine & ~space & (np.r_[True, space[:-1]] | (within == 0)))
    word = np.zeros(len(start), np.uint64)      # hash of the first six bytes of a word
    for i in range(6):
        at = np.minimum(start + i, len(buf) - 1)
        word = word * np.uint64(0x100000001B3) + np.where(start + i < len(buf), buf[at], 0).astype(np.uint64)
        # bytes behind the word's piece do not count
        word[(start + i < len(buf)) & (within[at] < i)] = 0
    word ^= word >> np.uint64(29)
    seen = np.unique(passage[start].astype(np.uint64) << np.uint64(24) | word & np.uint64((1 << 24) - 1))
    distinct = np.bincount((seen >> np.uint64(24)).astype(np.int64), minlength=total)
    words = np.bincount(passage[start], minlength=total)
    x[:, -2] = distinct / np.maximum(words, 1)
    x[:, -1] = length / PASSAGE
    return row, x


def passages(texts: list[bytes]):
    """Batches ``(row, features)`` of the passages of all texts, in order."""
    pieces = list(_pieces(texts))
    for i, j in chunks([len(p[1]) for p in pieces], CHUNK):
        yield _describe(pieces[i:j])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Gated-attention pooling over encoded passages."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def score(self, texts: list[bytes]) -> np.ndarray:
        p, rows, logits, votes = self.p, [], [], []
        for row, x in passages(texts):
            h = np.tanh((x - p["mean"]) / p["scale"] @ p["W"] + p["b"])
            logits.append(np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"]) @ p["w"])
            votes.append(h @ p["c"])
            rows.append(row)
        if not rows:
            return np.empty(0)
        row, a, v = (np.concatenate(z).astype(np.float64 if k else np.int64) for k, z in enumerate((rows, logits, votes)))
        n = len(texts)
        top = np.full(n, -np.inf)
        np.maximum.at(top, row, a)
        e = np.exp(a - top[row])
        z = np.bincount(row, weights=e * v, minlength=n) / np.bincount(row, weights=e, minlength=n)
        return _sigmoid(z + p["d"][0])


def fit(bags: list[tuple[np.ndarray, float, float]], hidden: int = 24, gate: int = 12, epochs: int = 30,
        rate: float = 0.01, seed: int = 5) -> Model:
    """``bags``: (features, label, weight). Adam on the weighted log loss. With
    labels of one kind only, the score is that label's share."""
    rng = np.random.default_rng(seed)
    dim = FEATURES
    every = np.concatenate([b[0] for b in bags]) if bags else np.zeros((1, dim))
    scale = every.std(0) + 1e-2
    p = {"mean": every.mean(0), "scale": scale, "W": rng.normal(0, dim ** -0.5, (dim, hidden)),
         "b": np.zeros(hidden), "V": rng.normal(0, hidden ** -0.5, (hidden, gate)),
         "U": rng.normal(0, hidden ** -0.5, (hidden, gate)), "w": rng.normal(0, gate ** -0.5, gate),
         "c": rng.normal(0, hidden ** -0.5, hidden), "d": np.zeros(1)}
    learned = ["W", "b", "V", "U", "w", "c", "d"]
    if len({b[1] for b in bags}) < 2:
        p["c"][:] = 0
        p["d"][0] = 0.0 if not bags else (4.0 if bags[0][1] else -4.0)
        return Model(p)
    x_all = [(b[0] - p["mean"]) / scale for b in bags]
    m = {k: np.zeros_like(p[k]) for k in learned}
    v = {k: np.zeros_like(p[k]) for k in learned}
    step = 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 64)):
            x = np.concatenate([x_all[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(x_all[i]) for i in batch])
            y = np.array([bags[i][1] for i in batch])
            wt = np.array([bags[i][2] for i in batch])
            n = len(batch)
            h = np.tanh(x @ p["W"] + p["b"])
            t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
            a = t * s @ p["w"]
            top = np.full(n, -np.inf)
            np.maximum.at(top, row, a)
            e = np.exp(a - top[row])
            att = e / np.bincount(row, weights=e, minlength=n)[row]
            vote = h @ p["c"]
            z = np.bincount(row, weights=att * vote, minlength=n)
            dz = (_sigmoid(z + p["d"]) - y) * wt / wt.sum()
            d_vote = dz[row] * att
            d_a = dz[row] * att * (vote - z[row])
            g = {"d": np.array([dz.sum()]), "c": h.T @ d_vote, "w": (t * s).T @ d_a}
            d_ts = d_a[:, None] * p["w"]
            d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
            g["V"], g["U"] = h.T @ d_t, h.T @ d_s
            d_h = (d_vote[:, None] * p["c"] + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
            g["W"], g["b"] = x.T @ d_h + 1e-4 * p["W"], d_h.sum(0)
            step += 1
            for k in learned:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(p)


def held_out(id_col):
    """True for the fifth of the ids that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
          per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """Learn from ``labels`` (0 or 1; other values and null ids are ignored; of
    several labels of one id the smallest counts) outside the held-out fifth.
    An id is learned from once, however many rows repeat it."""
    ready(docs.sparkSession)
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
             .where("_id is not null and _y in (0, 1)").where(~held_out("_id"))
             .groupBy("_id").agg(F.min("_y").alias("_y")))
    known = known.join(
        docs.where(F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) <= max_bytes)
        .select(F.col(id_col).alias("_id")), "_id", "left_semi")
    known = cut(known)
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    some = picks[0].unionByName(picks[1])       # at most 2 * per_class rows
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = (docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(some), "_id")
            .where(F.octet_length("_text") <= max_bytes).withColumn("_h", F.xxhash64("_text")))
    # of several rows of one id that of the smallest text hash counts
    one = cut(rows.groupBy("_id").agg(F.min("_h").alias("_h")))
    rows = rows.join(F.broadcast(one), ["_id", "_h"]).select("_id", "_text", "_y")

    def describe(batches):
        seen = set()        # at most 2 * per_class ids
        for batch in batches:
            new = []
            for i, x in enumerate(batch.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            if not new:
                continue
            batch = batch.take(pa.array(new, pa.int64()))
            texts = batch.column(1).to_pylist()
            parts: list[list[np.ndarray]] = [[] for _ in texts]
            for row, x in passages(texts):
                for r, part in zip(np.unique(row).tolist(), np.split(x, np.flatnonzero(np.diff(row)) + 1)):
                    parts[r].append(part)
            got = [np.concatenate(p).astype("<f4").tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())],
                                             names=["id", "y", "x"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = (rows.mapInArrow(describe, f"id {kind}, y int, x binary")
           .groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect())
    got.sort(key=lambda r: (r["id"], bytes(r["x"])))
    n = {y: max(1, sum(r["y"] == y for r in got)) for y in (0, 1)}
    return fit([(np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(np.float64), float(r["y"]),
                 totals.get(r["y"], 0) / n[r["y"]]) for r in got])


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """``(id_col, score double)``, one row per row, from the text alone. Null
    counts as empty; an empty text is one empty passage."""
    ready(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.p)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    src = df.select(F.col(id_col).alias("id"), text.alias("text"))

    def run(batches):
        known = Model(shared.value)
        for batch in (part for b in batches for part in slices(b, 1, 4 << 20)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(known.score(batch.column(1).to_pylist()), pa.float64())],
                names=["id", "score"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def filter_rows(df: DataFrame, text_col: str, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose text scores at least ``threshold``, all columns."""
    ready(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.p)
    at = df.columns.index(text_col)

    def run(batches):
        known = Model(shared.value)
        for batch in (part for b in batches for part in slices(b, at, 4 << 20)):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            good = known.score([t or b"" for t in texts]) >= threshold
            yield batch.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` of every row of ``docs``."""
    model = train(docs, labels, id_col, text_col, label_col)
    return score(docs, id_col, text_col, model).select(
        id_col, held_out(id_col).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
