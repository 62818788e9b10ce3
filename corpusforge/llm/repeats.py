"""Removal of byte strings that occur elsewhere (operator 10).

A byte goes if some window of ``threshold`` bytes that covers it also starts at
another place of the corpus. The windows are the suffixes cut at ``threshold``
bytes, ordered most significant digit first; a group that stays together
through all digits is a repeated window, and a group of one is dropped as soon
as it is alone. Ordering every suffix of the corpus would move 16 bytes or more
for each byte of text, so whole runs of windows go through a pass as one row:

1. First digit: the 32-byte gram with the smallest hash inside the window (its
   anchor, leftmost if equal). Equal windows have the same anchor at the same
   offset, and neighbouring windows share theirs, so one row stands for more
   than a hundred windows. An anchor whose gram occurs once ends all of its windows here.
2. Second digit: the anchor's whole context, all bytes of the windows that it is
   the anchor of (768 at most). Rows that agree here are repeated over the whole context and
   are settled; one of each group goes on, as a partner for the others.
3. Last digits: the remaining contexts travel to their gram group and every
   window in them is compared through ``threshold`` bytes. The windows of an
   anchor that repeat give one span, from the first to the last.

Groups of more than ``GROUP`` contexts are never held together: their windows
become rows, counted by a hash aggregate with partial aggregation. The first
digit is only a key; the digits that decide on equality are polynomial hashes
modulo two primes of 31 bits (62 bits in all), which structured text does not
tie as it ties one modulo a power of two. Two different windows count as equal
only if both residues collide.

The first digit is counted before anything else moves: a pass emits the grams
alone, and only anchors whose gram occurs again become rows of the later passes.

Text is moved only if the list of anchors wanted from it is too large to
broadcast (the size is measured first).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import chunks, cut, join_checked, ready, slices

GRAM = 32                # bytes of the first digit
PIECE = 1 << 17          # window starts of a long text handled at a time
CHUNK = 1 << 17          # bytes of text handled at a time, each as some twenty 64-bit numbers
GROUP = 4096             # contexts of one gram compared in one task
BATCH = 1024             # contexts of small grams compared at a time

_TABLE = np.random.default_rng(7).integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = 0x9E3779B97F4A7C15
#: Moduli and bases of the hashes that decide on equality (fixed values).
_PRIMES = (2147483647, 2147483629)
_BASES = (1315423911, 1776543211)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int, mod: int = 2 ** 64) -> np.ndarray:
    """``base ** i`` modulo ``mod``, which is 2**64 or a prime under 2**31."""
    have = _POWERS.get((base, mod))
    if have is None or len(have) < n:
        if mod == 2 ** 64:
            have = np.full(n, base, np.uint64)
            have[0] = 1
            have = np.cumprod(have)
        else:       # doubling: the second half is the first times base ** half
            have = np.ones(1, np.uint64)
            while len(have) < n:
                have = np.r_[have, have * np.uint64(pow(base, len(have), mod)) % np.uint64(mod)]
        _POWERS[base, mod] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _grams(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at every byte, for choosing anchors: a polynomial
    modulo 2**64, fast and good enough for a key."""
    pre = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * _powers(_MUL, len(buf)), out=pre[1:])
    return _mix((pre[gram:] - pre[:-gram]) * _powers(pow(_MUL, -1, 2 ** 64), len(buf) - gram + 1))


def _prefix(buf: np.ndarray) -> list[np.ndarray]:
    """Prefix sums of the two polynomials, along the last axis. Sums of fewer
    than 2**32 terms under 2**31 fit in 64 bits."""
    out = []
    for p, base in zip(_PRIMES, _BASES):
        pre = np.zeros((*buf.shape[:-1], buf.shape[-1] + 1), np.uint64)
        np.cumsum(buf.astype(np.uint64) * _powers(base, buf.shape[-1] + 1, p)[1:] % np.uint64(p), axis=-1, out=pre[..., 1:])
        out.append(pre % np.uint64(p))
    return out


def _between(pre: list[np.ndarray], a, z, shift: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``a`` to ``z`` (indexes into the last axis), of
    which ``shift`` stand before them."""
    parts = []
    for x, p, base in zip(pre, _PRIMES, _BASES):
        back = _powers(pow(base, -1, p), int(shift.max(initial=0)) + 1, p)[shift]
        parts.append((x[..., z] + np.uint64(p) - x[..., a]) % np.uint64(p) * back % np.uint64(p))
    return parts[0] << np.uint64(31) | parts[1]


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    m, w = v, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    return np.minimum(m[:len(m) - (width - w)], m[width - w:]) if w < width else m


def _pieces(texts, t: int, gram: int):
    """``(row, from, own_from, own_to, bytes)`` of every text of at least ``t``
    bytes; long texts in overlapping pieces that own disjoint anchors."""
    for row, b in enumerate(texts):
        if len(b) <= PIECE:
            if len(b) >= t:
                yield row, 0, 0, len(b), b
        else:
            for a in range(0, len(b), PIECE):
                lo = max(0, a - (t - gram))
                part = b[lo:a + PIECE + t]
                if len(part) >= t:
                    yield row, lo, a, a + PIECE, part


def _anchor_rows(pieces, t: int, gram: int, only_grams: bool = False):
    """Gram hashes of the anchors, or arrays row, pos, left, right, gram hash, context hash and number of the
    anchors, one entry for all anchors of a piece that agree in gram and
    context (pos is the first), and their merged spans: ends of each entry's
    list, starts and ends of the spans. Periodic text has an anchor in every
    period, which this keeps from becoming rows."""
    row, lo, own, end, parts = zip(*pieces)
    row, lo, own, end = map(np.array, (row, lo, own, end))
    size = np.array([len(p) for p in parts])
    off = np.concatenate([[0], np.cumsum(size)])
    buf = np.frombuffer(b"".join(parts), np.uint8)
    g = _grams(buf, gram)
    low = np.uint64((1 << 24) - 1)
    at = _sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), t - gram + 1) & low
    piece = np.repeat(np.arange(len(parts)), size)[:len(at)]
    inside = off[piece + 1] - np.arange(len(at)) >= t
    start, p, piece = np.flatnonzero(inside), at[inside].astype(np.int64), piece[inside]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])    # anchors move right only
    a, z = start[first], start[np.r_[first[1:], len(p)] - 1] + t
    p, piece = p[first], piece[first]
    pos = p - off[piece] + lo[piece]
    mine = (pos >= own[piece]) & (pos < end[piece])
    p, piece, pos, a, z = p[mine], piece[mine], pos[mine], a[mine], z[mine]
    if only_grams:
        return g[p]
    ctx = _mix(_between(_prefix(buf), a, z, a)) ^ _mix(((p - a) * 4096 + (z - p)).astype(np.uint64))
    left, right, g = p - a, z - p, g[p]
    order = np.lexsort((pos, ctx, g, piece))
    piece, pos, left, right, g, ctx = (x[order] for x in (piece, pos, left, right, g, ctx))
    new = np.r_[True, (piece[1:] != piece[:-1]) | (g[1:] != g[:-1]) | (ctx[1:] != ctx[:-1])][:len(pos)]
    apart = np.r_[True, pos[1:] - left[1:] > pos[:-1] + right[:-1]][:len(pos)] | new
    first, span = np.flatnonzero(new), np.flatnonzero(apart)
    last = np.r_[span[1:], len(pos)] - 1
    lists = np.r_[np.searchsorted(span, first), len(span)]
    return (row[piece[first]], pos[first], left[first], right[first], g[first], ctx[first],
            np.diff(np.r_[first, len(pos)]), lists, pos[span] - left[span], (pos[last[:len(span)]] + right[last[:len(span)]]))


def _anchor_grams(t: int, gram: int):
    """Texts -> ``(gram, n)``, one row per distinct gram of a run of bytes."""
    def run(batches):
        for batch in (part for b in batches for part in slices(b, 2, 4 * CHUNK)):
            pieces = list(_pieces(batch.column(2).to_pylist(), t, gram))
            found = [_anchor_rows(pieces[i:j], t, gram, True) for i, j in chunks([len(p[4]) for p in pieces], CHUNK)]
            if found:
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["gram", "n"])
    return run


def _anchors(t: int, gram: int):
    def run(batches):
        for batch in (part for b in batches for part in slices(b, 2, 4 * CHUNK)):
            pieces = list(_pieces(batch.column(2).to_pylist(), t, gram))
            for i, j in chunks([len(p[4]) for p in pieces], CHUNK):
                row, pos, left, right, g, ctx, n, lists, s, e = _anchor_rows(pieces[i:j], t, gram)
                own = pa.array(row)
                spans = pa.StructArray.from_arrays([pa.array(s), pa.array(e)], names=["s", "e"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(pos),
                     pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)),
                     pa.array(g.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), spans)],
                    names=["id", "h", "pos", "l", "r", "gram", "ctx", "n", "spans"])
    return run


def _window_hashes(texts: list[bytes], t: int):
    """Hash of every window: matrix (context, start), and the mask of the
    starts that exist."""
    size = np.array([len(b) for b in texts])
    width = int(size.max())
    span = width - t + 1
    buf = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in texts), np.uint8).reshape(len(texts), width)
    at = np.arange(span)
    return _between(_prefix(buf), at, at + t, at), at <= (size - t)[:, None]


def _repeats_in_groups(t: int):
    """Batches of contexts sorted by gram -> spans of repeated windows."""
    def spans(rows):
        left = rows.column("l").to_numpy()
        h, real = _window_hashes(rows.column("text").to_pylist(), t)
        who = np.nonzero(real)[0]
        _, key = np.unique(h[real], return_inverse=True)
        n = np.bincount(key, weights=rows.column("n").to_numpy()[who])
        again = np.zeros(h.shape, bool)
        again[real] = n[key] >= 2
        some = np.flatnonzero(again.any(1))
        base = rows.column("pos").to_numpy()[some] - left[some]
        first = again[some].argmax(1)
        last = h.shape[1] - 1 - again[some, ::-1].argmax(1)
        keep = pa.array(some)
        return pa.RecordBatch.from_arrays(
            [rows.column("id").take(keep).combine_chunks(), rows.column("h").take(keep).combine_chunks(),
             pa.array(base + first), pa.array(base + last + t)], names=["id", "h", "s", "e"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.concat_tables([x for x in (held, pa.Table.from_batches([b])) if x is not None])
            grams = held.column("gram").to_numpy()
            while True:     # whole grams only; the last one may go on in the next batch
                starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])[1:]
                if not len(starts) or starts[-1] < BATCH:
                    break
                end = int(starts[np.searchsorted(starts, BATCH)])
                yield spans(held.slice(0, end).combine_chunks())
                held, grams = held.slice(end), grams[end:]
        while held is not None and held.num_rows:
            grams = held.column("gram").to_numpy()
            starts = np.r_[np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])[1:], len(grams)]
            end = int(starts[min(np.searchsorted(starts, BATCH), len(starts) - 1)])
            yield spans(held.slice(0, end).combine_chunks())
            held = held.slice(end)
    return run


def _window_rows(t: int):
    """Contexts of large grams -> one row per window."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                rows = b.slice(i, BATCH)
                left = rows.column("l").to_numpy()
                h, real = _window_hashes(rows.column("text").to_pylist(), t)
                who, start = np.nonzero(real)
                own = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c).take(own) for c in ("gram", "id", "h", "pos", "n")]
                    + [pa.array(start + (rows.column("pos").to_numpy() - left)[who]),
                       pa.array(h[real].view(np.int64))],
                    names=["gram", "id", "h", "pos", "n", "s", "w"])
    return run


def _kept_runs(b: bytes, cuts) -> list[bytes]:
    at, parts = 0, []
    for c in cuts:
        parts.append(b[at:c["s"]])
        at = c["e"]
    return [*parts, b[at:]]


def _decoded(parts: list[bytes]) -> str:
    """The runs as text; a cut that starts or ends inside a character takes all of it."""
    return "".join(x.decode(errors="ignore") for x in parts)


def _cut_out(batches):
    for batch in (part for b in batches for part in slices(b, 1, 4 * CHUNK)):
        texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        runs = [_kept_runs(b, cuts) if cuts else [b] for b, cuts in zip(texts, spans)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([b"".join(x) for x in runs], pa.binary()),
             pa.array(map(_decoded, runs), pa.string())], names=["id", "text", "spans", "kept", "kept_text"])


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def repeated_spans(df: DataFrame, id_col: str, text_col: str, threshold: int = 400) -> DataFrame:
    """``(id, h, s, e)``: the maximal byte runs ``[s, e)`` covered by repeated
    windows, for every row (named by its id and the hash of its text)."""
    ready(df.sparkSession)
    t, gram = threshold, min(GRAM, threshold)
    src = _source(df, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()
    long_enough = src.where(F.length("text") >= t)
    again = cut(long_enough.mapInArrow(_anchor_grams(t, gram), "gram long, n long")
                .groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"))
    anchors = cut(join_checked(long_enough.mapInArrow(
        _anchors(t, gram), f"id {kind}, h long, pos long, l int, r int, gram long, ctx long, "
        "n long, spans array<struct<s:bigint,e:bigint>>"), again, "gram", "left_semi", 32 * again.count()))
    classes = anchors.groupBy("gram", "ctx").agg(
        F.sum("n").alias("n"), F.min(F.struct("id", "h", "pos", "l", "r")).alias("one"))
    classes = cut(classes)
    same = classes.where("n > 1").select("gram", "ctx")
    full = (anchors.join(same, ["gram", "ctx"])
            .select("id", "h", F.explode("spans").alias("x")).select("id", "h", "x.*"))
    several = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    wanted = (classes.join(several, "gram")
              .groupBy(F.col("one.id").alias("id"), F.col("one.h").alias("h"))
              .agg(F.collect_list(F.struct("gram", "size", F.least("n", F.lit(2)).cast("int").alias("n"),
                                           "one.pos", "one.l", "one.r")).alias("want")))
    wanted = cut(wanted)
    total = wanted.agg(F.sum(40 * F.size("want") + 64)).first()[0] or 0
    hit = wanted.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "want")
    texts = join_checked(src, hit, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")),
                         "inner", total)
    ctx = texts.select("id", "h", F.explode(F.transform("want", lambda w: F.struct(
        w["gram"].alias("gram"), w["size"].alias("size"), w["n"].alias("n"), w["pos"].alias("pos"),
        w["l"].alias("l"), F.call_function("substring", F.col("text"), (w["pos"] - w["l"] + 1).cast("int"),
                                           w["l"] + w["r"]).alias("text")))).alias("c")).select("id", "h", "c.*")
    out = f"id {kind}, h long, s long, e long"
    small = (ctx.where(F.col("size") <= GROUP).drop("size").repartition("gram").sortWithinPartitions("gram")
             .mapInArrow(_repeats_in_groups(t), out))
    rows = ctx.where(F.col("size") > GROUP).drop("size").mapInArrow(
        _window_rows(t), f"gram long, id {kind}, h long, pos long, n int, s long, w long")
    if several.where(F.col("size") > GROUP).isEmpty():
        part = small
    else:
        rows = cut(rows)
        twice = rows.groupBy("gram", "w").agg(F.sum("n").alias("k")).where("k > 1").select("gram", "w")
        large = (rows.join(twice, ["gram", "w"]).groupBy("id", "h", "pos")
                 .agg(F.min("s").alias("s"), (F.max("s") + t).alias("e")).select("id", "h", "s", "e"))
        part = small.unionByName(large)
    # rows that repeat an id and a text name the same spans, which count once
    spans = full.unionByName(part).distinct()
    # overlapping and touching spans of a document become one run
    by = Window.partitionBy("id", "h").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = (spans.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
            .withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))))
    return runs.groupBy("id", "h", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def _span_lists(df: DataFrame, id_col: str, text_col: str, threshold: int):
    """``(_id2, _h2, _spans)``, one row per text with runs, and its size in bytes."""
    spans = repeated_spans(df, id_col, text_col, threshold)
    spans = cut(spans.groupBy(F.col("id").alias("_id2"), F.col("h").alias("_h2"))
                .agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_spans")))
    return spans, spans.agg(F.sum(32 * F.size("_spans") + 64)).first()[0] or 0


def remove_repeats(df: DataFrame, id_col: str, text_col: str, threshold: int = 400) -> DataFrame:
    """One row per row of ``df``: ``(id_col, text, spans, kept, kept_text)`` with
    the bytes of the text, the removed runs ``[s, e)`` in order (null if none),
    the remaining bytes, and these as text (without characters cut through).
    Null text counts as empty. Rows that repeat an id and a
    text are rows like any other, so each repeats the other's windows; a null
    id is a value like any other. Other columns are not read."""
    spans, total = _span_lists(df, id_col, text_col, threshold)
    src = _source(df, id_col, text_col)
    both = join_checked(src, spans, F.col("id").eqNullSafe(F.col("_id2")) & (F.col("h") == F.col("_h2")),
                        "left", total).select("id", "text", F.col("_spans").alias("spans"))
    kind = both.schema["id"].dataType.simpleString()
    return both.mapInArrow(
        _cut_out, f"id {kind}, text binary, spans array<struct<s:bigint,e:bigint>>, kept binary, kept_text string"
    ).withColumnRenamed("id", id_col)


def _cut_text(at: int, chars: int | None):
    """Rows with ``spans`` in the last column -> the rows without it, the text
    cut, and column ``chars`` set to the length of the new text."""
    def run(batches):
        for batch in (part for b in batches for part in slices(b, at, 4 * CHUNK)):
            texts, spans = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = []
            for b, cuts in zip(texts, spans):
                new.append(_decoded(_kept_runs(b, cuts)) if cuts else None if b is None else b.decode())
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(new, pa.string())
            if chars is not None:
                kind = cols[chars].type
                cols[chars] = pa.array([None if t is None else len(t) if c else old.as_py()
                                        for t, c, old in zip(new, spans, cols[chars])], kind)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])
    return run


def cut_rows(df: DataFrame, id_col: str, text_col: str, threshold: int = 400,
             chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``df`` with the repeated runs cut out of the text; a
    character cut through goes as a whole. ``chars_col``, if there is one,
    follows a changed text. Null texts stay null; texts may become empty."""
    spans, total = _span_lists(df, id_col, text_col, threshold)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # names of the other side that no column of the rows has
    cols, pad = df.columns, "_"
    while any(c.startswith(pad) for c in cols):
        pad += "_"
    spans = spans.toDF(pad + "id", pad + "h", pad + "spans")
    both = join_checked(df, spans, F.col(id_col).eqNullSafe(F.col(pad + "id")) & (F.xxhash64(text) == F.col(pad + "h")),
                        "left", total).select(*[F.col(f"`{c}`") for c in cols], pad + "spans")
    return both.mapInArrow(_cut_text(cols.index(text_col), cols.index(chars_col) if chars_col in cols else None),
                           df.schema)
