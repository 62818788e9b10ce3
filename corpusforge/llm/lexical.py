"""Ranked lexical search by dense blocked matrix products (operator 11).

The items are a stated query set. They pass in blocks whose item-by-term matrix
has at most ``CELLS`` cells, so what is sent to the executors is bounded however
many items there are. For each block:

1. One pass over the documents counts N, L and, for the block's terms, df. A
   task sends one row per term.
2. A second pass makes tiles of ``DOCS`` documents. A document's impacts (the
   part of the score that does not depend on the item) fill the rows of a dense
   matrix that has columns for the terms of the tile only; its product with
   those rows of the weight matrix gives the scores. Both are whole numbers held
   in float64, and columns are taken in runs whose largest possible sum stays
   under 2**53, so every partial sum is exact. Runs are added up as 64-bit integers.
3. Each task keeps the best ``k`` of every item, by score and then id, and
   sends them once. Two window steps, the first over slices of an item's
   rows, give the ranks, so no task sorts all rows of an item.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import ready, slices
from corpusforge.llm.words import Numbers, parts

CELLS = 1 << 22         # terms times items of a block
DOCS = 256              # documents of a tile
COLUMNS = 4096          # terms of a tile multiplied at a time
CHUNK = 4 << 20         # bytes of text split at a time
EXACT = 1 << 53
SCALE = 1_000_000_000

#: Terms are runs of ASCII letters and digits and of all that is not ASCII; A-Z lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_blocks(items: DataFrame):
    """``(ids, vocabulary, term numbers per item)`` of runs of items."""
    ids, vocabulary, of = [], Numbers(), []
    for item, text in items.toLocalIterator():
        own = list(dict.fromkeys(t for part in parts(bytes(text), CHUNK) for t in terms(part)))
        more = sum(t not in vocabulary for t in own)
        if ids and (len(vocabulary) + more) * (len(ids) + 1) > CELLS:
            yield ids, vocabulary, of
            ids, vocabulary, of = [], Numbers(), []
        ids.append(item)
        of.append(vocabulary.of(own))
    if ids:
        yield ids, vocabulary, of


def _count(vocabulary):
    """Documents -> ``(term, n)``: df of the terms, N as term -1, L as -2."""
    def run(batches):
        known = vocabulary.value
        df = np.zeros(len(known), np.int64)
        n_docs = n_terms = 0
        for batch in (s for b in batches for s in slices(b, 1, CHUNK)):
            for raw in batch.column(1).to_pylist():
                found, n = set(), 0
                for part in parts(raw, CHUNK):
                    words = terms(part)
                    n += len(words)
                    found.update(known.keys() & words)
                n_docs += n > 0
                n_terms += n
                df[[known[w] for w in found]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, some]), pa.array(np.r_[n_docs, n_terms, df[some]])],
                                         names=["term", "n"])
    return run


def _runs(bound: np.ndarray):
    """Runs of columns whose bounds add up to less than ``EXACT``."""
    start, total = 0, 0
    for i, b in enumerate(bound.tolist()):
        if i > start and (total + b >= EXACT or i - start >= COLUMNS):
            yield start, i
            start, total = i, 0
        total += b
    yield start, len(bound)


class _Best:
    """The best ``k`` documents of every item: score, then id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.id = np.zeros((items, k), np.int64)
        self.nul = np.ones((items, k), bool)

    def add(self, score: np.ndarray, ids: np.ndarray, nul: np.ndarray) -> None:
        """``score``: items by documents."""
        some = np.flatnonzero((score >= np.maximum(self.score[:, -1:], 1)).any(1))
        if not len(some):
            return
        s = np.concatenate([self.score[some], score[some]], 1)
        i = np.concatenate([self.id[some], np.broadcast_to(ids, (len(some), len(ids)))], 1)
        n = np.concatenate([self.nul[some], np.broadcast_to(nul, (len(some), len(ids)))], 1)
        order = np.lexsort((i, n, -s), axis=-1)[:, :self.k]
        for have, new in ((self.score, s), (self.id, i), (self.nul, n)):
            have[some] = np.take_along_axis(new, order, 1)


def _score(block, k: int):
    """Documents -> ``(item, score, doc, nul)``: a task's best of every item."""
    def run(batches):
        known, weights, of, n_docs, n_terms = block.value
        matrix = np.zeros((len(known), len(of)))
        for item, own in enumerate(of):
            matrix[own, item] = weights[own]
        best = _Best(len(of), k)
        for batch in (s for b in batches for s in slices(b, 1, CHUNK)):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            nul = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for a in range(0, len(texts), DOCS):
                tile = texts[a:a + DOCS]
                who, which, size = [], [], []
                for d, raw in enumerate(tile):
                    n = 0
                    for part in parts(raw, CHUNK):
                        words = terms(part)
                        n += len(words)
                        hit = [known[w] for w in words if w in known]
                        which += hit
                        who += [d] * len(hit)
                    size.append(n)
                if not which:
                    continue
                m = np.array([50 + 50 * n * n_docs // n_terms for n in size], np.int64)
                cell, tf = np.unique(np.array(who) * len(known) + np.array(which), return_counts=True)
                d, t = cell // len(known), cell % len(known)
                impact = SCALE * tf // (1000 * tf + 20 * m[d])
                cols, t = np.unique(t, return_inverse=True)
                dense = np.zeros((len(tile), len(cols)))
                dense[d, t] = impact
                score = np.zeros((len(tile), len(of)), np.int64)
                bound = weights[cols] * (SCALE // 1000)     # no impact is above this
                for x, y in _runs(bound):
                    score += (dense[:, x:y] @ matrix[cols[x:y]]).astype(np.int64)
                best.add(score.T, ids[a:a + DOCS], nul[a:a + DOCS])
        item, place = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(best.score[item, place]), pa.array(best.id[item, place]),
             pa.array(best.nul[item, place])], names=["item", "score", "doc", "nul"])
    return run


def search(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
           k: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of the highest
    score above 0 for every row of ``items``, rank from 1, ties to the smaller
    id. Ids of documents are whole numbers, nulls last. Null and empty texts
    have no terms: such items have no rows and such documents no score. Rows
    that repeat an id are items or documents like any other. Other columns are
    not read. Very long texts are split in parts, of which only one at a time
    becomes words."""
    spark = docs.sparkSession
    ready(spark)
    raw = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    src = docs.select(F.col(doc_id).cast("long").alias("id"), raw(text).alias("text"))
    kind = items.schema[item_id].dataType
    out = []
    for ids, vocabulary, of in _item_blocks(items.select(item_id, raw(item_text))):
        if not vocabulary:
            continue
        known = spark.sparkContext.broadcast(dict(vocabulary))
        counts = dict(map(tuple, src.mapInArrow(_count(known), "term long, n long")
                          .groupBy("term").agg(F.sum("n")).collect()))      # one row per term of the block
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        if not n_terms:
            break
        weights = np.array([weight(n_docs, counts.get(t, 0)) for t in range(len(vocabulary))], np.int64)
        block = spark.sparkContext.broadcast((known.value, weights, of, n_docs, n_terms))
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, name {kind.simpleString()}")
        best = src.mapInArrow(_score(block, k), "item int, score long, doc long, nul boolean")
        order = [F.desc("score"), "nul", "doc"]
        salt = F.spark_partition_id() % max(1, math.isqrt(spark.sparkContext.defaultParallelism * 4))
        best = best.withColumn("slice", salt)
        for by in (("item", "slice"), ("item",)):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        out.append(best.join(F.broadcast(names), "item").select(     # at most CELLS names
            F.col("name").alias(item_id), F.col("rank").cast("int").alias("rank"),
            F.when(~F.col("nul"), F.col("doc")).cast(docs.schema[doc_id].dataType).alias(doc_id), "score"))
    if not out:
        return spark.createDataFrame([], f"`{item_id}` {kind.simpleString()}, rank int, "
                                         f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score long")
    return reduce(DataFrame.unionByName, out)
