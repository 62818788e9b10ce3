"""SimHash near-duplicates (operator 6).

Fingerprint: 64 bits, bit b set if more than half of the document's word
shingles have bit b set in their XXH64 (seed 42).

Linking all fingerprints within ``max_distance`` bits, without all pairs:

* Embedding. A fingerprint is cut into two-bit segments; the vector of segment
  popcounts (0, 1 or 2 each) is its embedding. One differing bit moves one
  coordinate by at most one, so the Manhattan distance of two embeddings is a
  lower bound of the Hamming distance.
* Grid range-join. The coordinates are dealt to ``g`` groups, ``g`` =
  max(2, d // 2 + 1). Within distance ``d`` some group is at Manhattan
  distance <= d // g <= 1. The grid has unit cells: a fingerprint stands in
  its own cell of each group, and in the cells one step up along each axis.
  Two points at distance 0 share their own cell; at distance 1 the step up of
  one is the own cell of the other. No link within the distance is lost.
* Verification by the exact bit distance, in Arrow batches that hold whole
  cells.

A cell is never held whole if it is large: its rows go to blocks of at most
about ``BLOCK`` fingerprints and every pair of blocks is one group of rows. A
batch emits a spanning forest of the links it found (at most one edge a row),
not the pairs, so large groups of near copies cost linear output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import chunks, cut, join_checked, merge_labels, ready, slices
from corpusforge.llm.components import components

SEED = 42
BLOCK = 4096            # fingerprints of one cell that one block holds
CHUNK = 1 << 16         # shingles expanded to bits at a time


def _hashes(text: bytes, k: int) -> np.ndarray:
    from xxhash import xxh64_intdigest
    words = text.lower().split()      # bytes: A-Z only; splits at \x20 and \x09-\x0D
    if len(words) <= k:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[:1 - k or None].tolist(), end[k - 1:].tolist()
    return np.fromiter((xxh64_intdigest(line[i:j], SEED) for i, j in zip(first, last)),
                       np.uint64, len(last))


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (uint64) of several documents, in runs of bounded size."""
    out = np.zeros(len(hashes), np.uint64)
    for a, b in chunks([len(h) for h in hashes], CHUNK):
        n = np.array([len(h) for h in hashes[a:b]])
        bits = np.zeros((b - a, 64), np.int64)
        if len(hashes[a]) > CHUNK:                      # one very long document
            for i in range(0, len(hashes[a]), CHUNK):
                part = hashes[a][i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
                bits[0] += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        elif n.sum():
            part = np.concatenate(hashes[a:b]).astype("<u8").view(np.uint8).reshape(-1, 8)
            some = np.flatnonzero(n)
            at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            bits[some] = np.add.reduceat(np.unpackbits(part, axis=1, bitorder="little"),
                                         at, axis=0, dtype=np.int32)
        more = (2 * bits > n[:, None]).astype(np.uint8)
        out[a:b] = np.packbits(more, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(k: int):
    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1, 4 << 20)):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fp = _majority([_hashes(t or b"", k) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))],
                                             names=["id", "fp"])
    return run


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``(id, fp long)``, one row per row of ``df``. Null text counts as empty;
    no words: 0; fewer words than ``shingle``: the whole sequence is hashed."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_fingerprint_batches(shingle), f"id {kind}, fp long")


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash (SplitMix64) of ``x``. Equal hashes of two cells only make more
    candidates, which the exact distance sorts out."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(max_distance: int):
    """Fingerprints -> ``(cell, fp, up)``, one row for every cell a fingerprint
    stands in. Vectorised: an expression with a lambda a segment left its arrays
    and rows to the JVM's heap."""
    groups = max(2, max_distance // 2 + 1)
    ups = max_distance // groups
    edges = [round(32 * i / groups) * 2 for i in range(groups + 1)]

    def cells(fp):
        every = np.arange(len(fp))
        for g, (a, b) in enumerate(zip(edges, edges[1:])):
            odd = np.uint64(int("01" * ((b - a) // 2), 2))
            x = fp >> np.uint64(a)
            pops = (x & odd) + (x >> np.uint64(1) & odd)
            yield _mixed(pops, g), every, False
            for j in range(0, b - a, 2) if ups else ():
                who = np.flatnonzero((pops >> np.uint64(j) & np.uint64(3)) < 2)
                yield _mixed(pops[who] + np.uint64(1 << j), g), who, True

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                fp = batch.column(0).slice(i, BLOCK).to_numpy().view(np.uint64)
                cell, who, up = zip(*cells(fp))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cell).view(np.int64)), pa.array(fp[np.concatenate(who)].view(np.int64)),
                     pa.array(np.repeat(up, [len(w) for w in who]))], names=["cell", "fp", "up"])
    return run


def _links_in_runs(max_distance: int):
    """Batches sorted by ``gid`` -> edges of a spanning forest of the links.
    A run of equal ``gid`` that a batch cuts is carried to the next one."""
    def forest(gid, fp, up):
        nodes, at = np.unique(fp, return_inverse=True)
        lab = np.arange(len(nodes))
        i, lag = np.arange(len(gid)), 1
        while True:
            i = i[i + lag < len(gid)]
            i = i[gid[i] == gid[i + lag]]
            if not len(i):
                break
            c = i[~(up[i] & up[i + lag])]
            near = np.bitwise_count(fp[c] ^ fp[c + lag]) <= max_distance
            merge_labels(lab, at[c[near]], at[c[near] + lag])
            lag += 1
        tied = np.flatnonzero(lab != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[tied].view(np.int64)),
                                           pa.array(nodes[lab[tied]].view(np.int64))], names=["u", "v"])

    def run(batches):
        gid, fp, up = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        for b in batches:
            gid = np.concatenate([gid, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            up = np.concatenate([up, b.column(2).to_numpy(zero_copy_only=False)])
            end = int(np.searchsorted(gid, gid[-1])) if len(gid) else 0
            if end:
                yield forest(gid[:end], fp[:end], up[:end])
                gid, fp, up = gid[end:], fp[end:], up[end:]
        if len(gid):
            yield forest(gid, fp, up)
    return run


def links(nodes: DataFrame, max_distance: int = 3, block: int = BLOCK) -> DataFrame:
    """``nodes``: distinct ``fp``. Edges ``(u, v)`` that connect exactly the
    fingerprints connected by links of at most ``max_distance`` bits."""
    rows = nodes.select("fp").mapInArrow(_cells(max_distance), "cell long, fp long, up boolean")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("only_up"))
    sizes = cut(sizes.where("n > 1 and not only_up").select(
        "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    # cells with one row, or with steps up alone, hold no pair
    hot = sizes.where("blocks > 1")
    n_hot = hot.count()
    rows = rows.join(sizes.select("cell"), "cell", "left_semi")
    if n_hot:
        rows = join_checked(rows, hot, "cell", "left", 32 * n_hot)
    else:
        rows = rows.withColumn("blocks", F.lit(None).cast("int"))
    blocks = F.coalesce("blocks", F.lit(1))
    rows = (rows.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("gid"),
                    "fp", "up"))
    return (rows.repartition("gid").sortWithinPartitions("gid")
            .mapInArrow(_links_in_runs(max_distance), "u long, v long"))


def simhash_groups(df: DataFrame, id_col: str, text_col: str, shingle: int = 3,
                   max_distance: int = 3) -> DataFrame:
    """One row per row of ``df``: ``(id_col, fingerprint, component_id)``.

    ``fingerprint``: 16 lowercase hex digits. ``component_id``: smallest
    non-null id reachable by links, its own included (null if there is none).
    Null and empty texts have fingerprint 0 and are linked like any other.
    Repeated rows stay repeated. Other columns are not read."""
    ready(df.sparkSession)
    fps = cut(fingerprints(df, id_col, text_col, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("low")))
    comp = components(links(nodes.select("fp"), max_distance))
    nodes = (nodes.join(comp, nodes.fp == comp.node, "left")
             .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")
