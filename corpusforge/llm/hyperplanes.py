"""Embedding near-duplicates (operator 5).

Rows of equal label and equal vector are one class. Every class gets, in each
of several tables, the signs of random projections; classes that share label,
table and sign word are compared by exact cosine. The word length follows the
number of classes (a bucket then holds few strangers), and the number of
tables follows the length, so that a pair at the threshold shares a bucket
with probability ``recall`` at any size.

Each compared pair counts once: in the first table where its words agree. A
bucket larger than ``BLOCK`` is cut into blocks and every pair of blocks is a
group of its own. A group gives one row per member (its links, and the smallest
member it is tied to), never the pairs, so a large group costs linear output.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import cut, join_checked, merge_labels, ready
from corpusforge.llm.components import components

BLOCK = 1024


def plan(n: int, threshold: float, recall: float = 0.98) -> tuple[int, int]:
    """Bits of a sign word and number of tables for ``n`` classes."""
    bits = min(62, max(8, math.ceil(math.log2(max(n, 2)))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _words(bits: int, tables: int, seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            vecs = b.column(1).to_pylist()
            out = np.zeros((len(vecs), tables), np.int64)
            dims = np.array([len(v) for v in vecs])
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).normal(size=(d, bits * tables))
                at = np.flatnonzero(dims == d)
                sign = (np.array([vecs[i] for i in at], np.float64) @ planes[d] > 0).reshape(len(at), tables, bits)
                out[at] = sign @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.tolist(), pa.list_(pa.int64()))],
                                             names=["c", "words"])
    return run


def _compare(threshold: float):
    """Rows sorted by group -> (c, links, root) of members with a link."""
    def group(own, cross, table, c, n, dim, words, vecs):
        m = len(c)
        links, lab = np.zeros(m, np.int64), np.arange(m)
        norm = np.sqrt((vecs * vecs).sum(1))
        for a in range(0, m, 256):
            z = min(a + 256, m)
            cos = vecs[a:z] @ vecs.T / (norm[a:z, None] * norm[None, :])
            i, j = np.nonzero(cos >= threshold)
            i += a
            ok = (i < j) & (dim[i] == dim[j])
            i, j = i[ok], j[ok]
            if cross:       # pairs inside a block have a group of their own
                ok = own[i] != own[j]
                i, j = i[ok], j[ok]
            if len(i):
                merge_labels(lab, i, j)
                new = ~(words[i][:, :table] == words[j][:, :table]).any(1) if table else np.ones(len(i), bool)
                np.add.at(links, i[new], n[j[new]])
                np.add.at(links, j[new], n[i[new]])
        some = np.flatnonzero((links > 0) | (lab != np.arange(m)))
        return c[some], links[some], c[lab[some]]

    def runs(t: pa.Table, last: bool):
        gid = t.column("gid").to_numpy()
        cuts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]]) if len(gid) else np.empty(0, int)
        ends = np.r_[cuts[1:], len(gid)]
        if not last:
            cuts, ends = cuts[:-1], ends[:-1]
        done = int(ends[-1]) if len(ends) else 0
        if not done:
            return None, t
        col = {k: t.column(k).to_numpy()[:done] for k in ("own", "cross", "t", "c", "n")}
        words = np.array(t.column("words").slice(0, done).to_pylist(), np.int64)
        vecs = t.column("v").slice(0, done).to_pylist()
        dim = np.array([len(v) for v in vecs])
        full = np.zeros((done, int(dim.max())))
        for i, v in enumerate(vecs):
            full[i, :len(v)] = v
        got = [group(col["own"][a:z], bool(col["cross"][a]), int(col["t"][a]), col["c"][a:z], col["n"][a:z], dim[a:z], words[a:z], full[a:z])
               for a, z in zip(cuts.tolist(), ends.tolist())]
        c, links, root = (np.concatenate(x) for x in zip(*got))
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(links), pa.array(root)],
                                          names=["c", "links", "root"]), t.slice(done)

    def run(batches):
        held = None
        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows >= 4 * BLOCK:
                out, held = runs(held, False)
                if out is not None:
                    yield out
        if held is not None and held.num_rows:
            yield runs(held, True)[0]
    return run


def near_groups(df: DataFrame, id_col: str, vec_col: str, label_col: str, threshold: float = 0.98,
                recall: float = 0.98, seed: int = 3) -> DataFrame:
    """One row per row of ``df``: ``(id_col, n_links, component_id, kept)``.

    Null labels, null ids and vectors that are null, empty, zero or hold null
    or non-finite components link with nothing (``component_id`` is the row's
    own id). Rows that repeat id, label and vector are one vector and give
    equal rows. Vectors of different length are never linked."""
    from corpusforge.llm.vafile import usable
    ready(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                    F.col(label_col).alias("label"))
    fits = usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    fits = F.coalesce(fits & F.exists("v", lambda x: x != 0), F.lit(False))
    src = src.withColumn("h", F.when(fits, F.struct("label", "v")))
    classes = cut(src.where("h is not null").select("id", "h").distinct().groupBy("h")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
                  .withColumn("c", F.monotonically_increasing_id()))
    bits, tables = plan(classes.count(), threshold, recall)
    words = cut(classes.select("c", F.col("h.v").alias("v")).mapInArrow(
        _words(bits, tables, seed), "c long, words array<long>"))
    keys = words.join(classes.select("c", F.col("h.label").alias("label")), "c").select(
        "c", F.posexplode("words").alias("t", "w"), "label").select(
        "c", "t", F.xxhash64("label", "t", "w").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut(keys.join(sizes, "key"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = (members.withColumn("own", F.pmod(F.xxhash64("c"), blocks).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
               .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("gid"),
                       "own", (F.col("own") != F.col("other")).alias("cross"), "t", "c"))
    rows = members.join(words, "c").join(classes.select("c", "n", F.col("h.v").alias("v")), "c")
    got = cut(rows.select("gid", "own", "cross", "t", "c", "n", "words", "v").repartition("gid").sortWithinPartitions("gid", "c")
              .mapInArrow(_compare(threshold), "c long, links long, root long"))
    comp = components(got.select(F.col("c").alias("u"), F.col("root").alias("v")))
    links = got.groupBy("c").agg(F.sum("links").alias("links"))
    info = (classes.join(links, "c", "left").join(comp, classes.c == comp.node, "left")
            .select("h", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                    F.coalesce("root", "c").alias("root")))
    low = info.groupBy("root").agg(F.min("low").alias("component_id"))
    info = cut(info.join(low, "root").select("h", "n_links", "component_id"))
    one = F.coalesce("component_id", "id")
    return (src.select("id", "h").join(info, "h", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    one.alias("component_id"), F.coalesce(F.col("id") == one, F.lit(False)).alias("kept")))
