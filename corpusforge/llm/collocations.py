"""Phrase collocations by vertical partitioning of truncated suffixes (operator 13).

The suffixes of the corpus at word borders, cut after ``longest`` words and at
the end of their piece, form a tree whose nodes' totals are the counts of the
phrases. The tree is never built as a whole, but level by level and in groups:

1. One pass counts words, the first level.
2. A pass for each further level k emits the suffixes cut after k words, but only
   where both phrases of k-1 words in them have ``least`` occurrences: no other
   can. The mappers know those phrases from a bitmap of fixed size; a bit set by
   two phrases only moves a suffix more, since exact counts decide at the end.
3. Groups share the suffixes by their prefix of k-1 words, whose count the level
   above gave: about ``BUDGET`` suffixes to a group, and a prefix of more than the
   budget is split by its next word.
4. Every group merges its suffixes and reads the totals of its leaves, independent
   of the others. A leaf lies in one group, so its total is whole.

Scores and the test for longer phrases are joins of the counted phrases with
themselves, in decimals of 38 digits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import cut, ready, slices
from corpusforge.llm.words import Numbers, binary, parts

BUDGET = 500_000        # suffixes of a group, counted before equal ones are merged
CHUNK = 4 << 20         # bytes of text whose equal suffixes are merged at a time
BITS = 1 << 26          # bits of the map of words (8 MB)

#: A-Z lower-cased, `[.,;:!?\x0A-\x0D]` to a line feed, tab to a space.
_FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b
              for b in range(256))
_CUT = re.compile(b"[ \n]")


def _runs(raw: bytes, longest: int):
    """``(words, own)`` of parts of a text, None between pieces; suffixes start
    at the first ``own`` of the words, the rest is read ahead."""
    ahead: list = []
    for part in parts(raw.translate(_FOLD), CHUNK, _CUT):
        words = ahead
        for piece in part.split(b"\n"):
            words += [w for w in piece.split(b" ") if w]
            words.append(None)
        if part[-1:] != b"\n":
            words.pop()     # the piece may go on
        keep = max(0, len(words) - longest + 1)
        yield words, keep
        ahead = words[keep:]
    yield ahead, len(ahead)


def _chunks(batches):
    """``(lang, texts)`` of about ``CHUNK`` bytes, every text of one language."""
    for batch in (s for b in batches for s in slices(b, 1, CHUNK)):
        by = defaultdict(list)
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by[lang].append(raw)
        yield from by.items()


def _numbered(texts, longest: int):
    """``(words, ids, own)``: the distinct words of texts and the texts as their
    numbers, -1 between pieces; ``own`` marks where suffixes start."""
    numbers = Numbers()
    numbers[None] = 0
    ids, own = [], []
    for raw in texts:
        for words, n in _runs(raw, longest):
            words.append(None)
            ids.append(numbers.of(words))
            own.append(np.arange(len(words)) < n)
            words.pop()
    ids = np.concatenate(ids)
    return list(numbers)[1:], ids - 1, np.concatenate(own) & (ids > 0)


def _word_counts(batches):
    for lang, texts in _chunks(batches):
        words, ids, own = _numbered(texts, 1)
        n = np.bincount(ids[own], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), binary(words), pa.array(n)],
                                         names=["lang", "w0", "n"])


def _place(hashes: list):
    """The bit of a phrase from the hashes of its words (columns of Spark)."""
    out = hashes[0]
    for i, h in enumerate(hashes[1:], 1):
        out = out.bitwiseXOR(F.shiftleft(h, 7 * i).bitwiseOR(F.shiftrightunsigned(h, 64 - 7 * i)))
    return out.bitwiseAND(F.lit(BITS - 1))


def _bitmap(phrases: DataFrame, names: list[str]) -> np.ndarray:
    """The bits of all phrases, built as maps of 32,768 bits by an aggregate: at
    most ``BITS`` / 8 bytes reach the driver."""
    at = _place([F.xxhash64("lang", c) for c in names])
    out = np.zeros(BITS // 8, np.uint8)
    for i, part in (phrases.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("i"))
                    .agg(F.call_function("bitmap_construct_agg", F.col("at").bitwiseAND(F.lit(32767)))).toLocalIterator()):
        out[i * 4096:(i + 1) * 4096] = np.frombuffer(bytes(part), np.uint8)
    return out


def _suffixes(k: int, shared):
    """Texts -> ``(lang, w0, ..., n)``: suffixes cut after ``k`` words whose
    phrases of ``k`` - 1 words are in the bitmap; equal ones of a chunk as one row."""
    def run(batches):
        bits = shared.value
        for lang, texts in _chunks(batches):
            words, ids, own = _numbered(texts, k)
            if not words:
                continue
            # hashes as Spark's xxhash64(lang, word) gives them
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)
            h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))[ids]
            at, n = h.copy(), len(ids)
            for i in range(1, k - 1):       # rotated as in `_place`
                at[:n - i] ^= h[i:] << np.uint64(7 * i) | h[i:] >> np.uint64(64 - 7 * i)
            at &= np.uint64(BITS - 1)
            good = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            inside = np.ones(n, bool)
            for i in range(k):
                inside[:n - i] &= ids[i:] >= 0
            x = np.flatnonzero(own[:n - k + 1] & inside[:n - k + 1] & good[:n - k + 1] & good[1:n - k + 2])
            if not len(x):
                continue
            rows, count = _unique([ids[x + i] for i in range(k)], len(words))
            table = binary(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(count), pa.string()), *(table.take(pa.array(r)) for r in rows), pa.array(count)],
                names=["lang", *(f"w{i}" for i in range(k)), "n"])
    return run


def _pack(cols: list[np.ndarray], base: int) -> np.ndarray:
    key = np.zeros(len(cols[0]) if cols else 0, np.int64)
    for c in cols:
        key = key * base + c
    return key


def _unique(cols: list[np.ndarray], base: int):
    """Distinct rows of columns of numbers below ``base``, and their counts."""
    if base ** len(cols) >= 1 << 62:
        return np.unique(np.stack(cols), axis=1, return_counts=True)
    key, n = np.unique(_pack(cols, base), return_counts=True)
    out = []
    for _ in cols:
        out.append(key % base)
        key = key // base
    return out[::-1], n


def _leaves(k: int, least: int):
    """The suffixes of groups, which arrive sorted by group -> totals of their
    leaves that have ``least`` occurrences. A group is one table."""
    by = ["lang", *(f"w{i}" for i in range(k))]

    def totals(held):
        rows = pa.Table.from_batches(held).group_by(by).aggregate([("n", "sum")]).select([*by, "n_sum"])
        yield from rows.filter(pc.greater_equal(rows.column("n_sum"), least)).rename_columns([*by, "n"]).to_batches(1 << 16)

    def run(batches):
        held, at = [], None
        for b in batches:
            group = b.column(0).to_numpy()
            ends = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)]
            for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                if j > i:
                    if at is not None and group[i] != at:
                        yield from totals(held)
                        held = []
                    at = group[i]
                    held.append(pa.RecordBatch.from_arrays(b.slice(i, j - i).columns[1:], names=b.schema.names[1:]))
        if held:
            yield from totals(held)
    return run


def _fields(n: int) -> str:
    return "lang string, " + "".join(f"w{i} binary, " for i in range(n)) + "n long"


def _phrase(cols: list[Column]) -> Column:
    """Words joined by a space, nulls left out."""
    return F.concat_ws(" ", *[c.cast("string") for c in cols])


def phrase_counts(df: DataFrame, lang_col: str, text_col: str, longest: int = 3, least: int = 10):
    """``(phrases, totals)``: ``phrases(lang, phrase, size, f)`` of one to
    ``longest`` words with at least ``least`` occurrences, and
    ``totals(lang, n)``, all word occurrences."""
    spark = df.sparkSession
    ready(spark)
    src = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    words = cut(src.mapInArrow(_word_counts, _fields(1)).groupBy("lang", "w0").agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // BUDGET))
    level = words.where(F.col("n") >= least)
    out = []
    for k in range(1, longest + 1):
        names = [f"w{i}" for i in range(k)]
        if k > 1:
            shared = spark.sparkContext.broadcast(_bitmap(level, names[:-1]))
            rows = src.mapInArrow(_suffixes(k, shared), _fields(k))
            full = level.where(F.col("n") > BUDGET).select("lang", *names[:-1], F.lit(True).alias("full"))
            prefix = F.xxhash64("lang", *names[:-1])
            if not full.isEmpty():      # at most suffixes / BUDGET rows
                rows = rows.join(F.broadcast(full), ["lang", *names[:-1]], "left")
                prefix = F.when(F.col("full"), F.xxhash64("lang", *names)).otherwise(prefix)
            rows = rows.select(F.pmod(prefix, F.lit(groups)).cast("int").alias("g"), "lang", *names, "n")
            level = cut(rows.repartition(groups, "g").sortWithinPartitions("g").mapInArrow(_leaves(k, least), _fields(k)))
        out.append(level.select("lang", F.concat_ws(" ", *[F.col(c).cast("string") for c in names]).alias("phrase"),
                                F.lit(k).alias("size"), F.col("n").alias("f")))
    return cut(reduce(DataFrame.unionByName, out)), totals


def collocations(df: DataFrame, lang_col: str, text_col: str, longest: int = 3, least: int = 10,
                 share: int = 50, k: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: for every language the ``k``
    phrases of 2 to ``longest`` words with the highest score, ties to the higher
    count and then the smaller phrase in byte order. ``share``: a phrase goes if
    a longer one that holds it has at least so many percent of its occurrences.
    Null languages count as ``und``, null texts as empty; an empty table gives
    no rows. Rows that repeat are texts like any other. Other columns are not
    read. Long texts are read in parts, each with the words that follow."""
    phrases, totals = phrase_counts(df, lang_col, text_col, longest, least)
    size = F.col("size")
    words = F.split("phrase", " ")
    piece = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cand = phrases.where(size > 1)
    long = cand.where(size > 2).select("lang", "f", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda a: piece(a, m)))))
        .alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    cuts = cand.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"), "size") \
        .select("lang", "phrase", "a", "cut", piece(1, F.col("cut")).alias("first"),
                piece(F.col("cut") + 1, size).alias("rest"))
    side = lambda name, value: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    ratio = F.call_function("div", (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)"),
                            wide("l") * wide("r"))
    best = (scored.select("lang", "phrase", "a", F.struct(ratio.cast("long").alias("score"), "cut", "l", "r").alias("c"))
            .groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), F.min("c").alias("c")))
    kept = best.join(long, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("a")))
    by = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r",
                                           "n", "c.score")
