"""Language-model scoring by Brown classes (operator 12).

P(w | v) = P(class(w) | class(v)) * P(w | class(w)): classes of words are learned
by exchange, so that the bigrams of classes are as likely as possible.

1. Texts become numbers once, in blocks of about ``BLOCK`` bytes with a word list
   of their own. The blocks are a table bucketed by block; everything later reads
   that table, and words travel as the distinct words of a block.
2. Word counts over all training texts are one hash aggregate.
3. Exchange. The ``frequent`` most frequent words are moved in sweeps. A task
   adds up how often each of them stands before and after each class; the sums
   meet by word, and every task moves its words one after the other to the class
   of the largest gain in log-likelihood, against its own copy of the class
   bigrams. The best of the assignments (by likelihood) stays. Then every other
   word, however rare, is moved once from the common class it was in until then.
   ``frequent`` bounds what is sent to the executors and what is swept more than
   once, not which words get a class.
4. Counts and classes go back to the blocks by a join on the word. One pass counts
   the class bigrams of all training texts, one scores all texts. A text over
   several blocks is the sum of its parts.

A training word seen once would be unknown without that sight, so its bigrams
also count for the class of unknown words. Class bigrams are smoothed towards the
class's share by ``prior`` counts and words by one count, so the probabilities
of all known words and the unknown one add up to 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import cut, ready, slices
from corpusforge.llm.words import Numbers, binary, parts
from corpusforge.session import bucketed_table, shuffles_dropped

BLOCK = 6 << 20         # bytes of text that share a word list; a row of every table is one block
CHUNK = 1 << 20         # bytes of text split at a time
STEP = 1 << 19          # tokens of a block looked at at a time
ENTRIES = 1 << 11       # neighbour counts of rare words weighed at a time, so that they stay in the cache
END = b""               # the end of a text; no word is empty

_PAIR = np.dtype([("at", "<i2"), ("n", "<i4")])


@dataclass
class Model:
    words: DataFrame        # (word binary, c, cls): all training words
    tokens: int             # N, ends included
    types: int              # V
    classes: int
    bigrams: np.ndarray     # class bigrams, unknown words last
    likelihood: list        # of the assignments swept


def _list(values: np.ndarray | pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _blocks(kind: pa.DataType):
    """Texts -> one row per block. ``size`` tokens of each part follow one token
    that stands before them: the end of a text, or the word before the part."""
    def run(batches):
        start = TaskContext.get().partitionId() << 33
        row, block = start, start
        state = None

        def fresh():
            numbers = Numbers()
            numbers[END] = 0
            return numbers, [], [], [], [], [], 0

        def flush(s):
            numbers, ids, rows, held, size, toks, _ = s
            learned = [np.empty(0, np.int32), *(tok[1:] for tok, h in zip(toks, held) if not h)]
            n = np.bincount(np.concatenate(learned), minlength=len(numbers)).astype(np.int32)
            tok = np.concatenate(toks)
            # numbers are in order of appearance, so most fit in two bytes
            low, high = np.minimum(tok, 65535).astype("<u2"), tok[tok >= 65535]
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), _list(pa.array(ids, kind)), _list(np.array(rows, np.int64)), _list(pa.array(held)),
                 _list(np.array(size, np.int32)), binary([low.tobytes()]), _list(high), _list(binary(numbers)), _list(n)],
                names=["block", "ids", "rows", "held", "size", "low", "high", "words", "n"])

        state = fresh()
        for batch in (s for b in batches for s in slices(b, 2, CHUNK)):
            for i, h, raw in zip(*(c.to_pylist() for c in batch.columns)):
                before = END
                pieces = list(parts(raw.lower(), CHUNK))
                for p, piece in enumerate(pieces):
                    words = piece.split()
                    if p == len(pieces) - 1:
                        words.append(END)
                    if not words:
                        continue
                    numbers, ids, rows, held, size, toks, total = state
                    ids.append(i)
                    rows.append(row)
                    held.append(h)
                    size.append(len(words))
                    toks.append(numbers.of([before, *words]).astype(np.int32))
                    before = words[-1]
                    state = (*state[:-1], total + len(piece) + 64)
                    if state[-1] >= BLOCK:
                        yield flush(state)
                        block += 1
                        state = fresh()
                row += 1
        if state[1]:
            yield flush(state)
    return run


def _pairs(batch: pa.RecordBatch, i: int, learn_only: bool):
    """Numbers of the tokens before, the tokens, and the part of each token, of
    row ``i`` in runs of at most ``STEP``; with ``learn_only`` of training texts."""
    col = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
    size, held = col("size"), col("held").astype(bool)
    tok = np.frombuffer(batch.column("low")[i].as_py(), "<u2").astype(np.int32)
    tok[tok == 65535] = col("high")
    part = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    at = np.flatnonzero(np.r_[False, part[1:] == part[:-1]] & ~(learn_only & held)[part]).astype(np.int32)
    for s in range(0, len(at), STEP):
        x = at[s:s + STEP]
        yield tok[x - 1], tok[x], part[x]


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


def _numbers_of(words: pa.Array, frequent: pa.Array) -> np.ndarray:
    """Places of words among the frequent ones, -1 for all others."""
    return pc.fill_null(pc.index_in(words.cast(pa.binary()), value_set=frequent), -1).to_numpy().astype(np.int64)


def _contexts(shared, k: int, bigrams_only: bool = False):
    """Blocks -> ``(w, v)``: counts of the classes before and after each frequent
    word and of its doubles; the class bigrams as word -1. After the last sweep no
    word moves, so ``bigrams_only`` leaves the words out."""
    g = k + 2

    def run(batches):
        frequent, classes = shared.value
        frequent = binary(frequent)
        m = 0 if bigrams_only else len(frequent)
        acc, double, bigrams = np.zeros(m * 2 * g, np.int64), np.zeros(m, np.int64), np.zeros(g * g, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                own = _numbers_of(batch.column("words")[i].values, frequent)
                cls = classes[own]      # the last one stands for all other words
                cls[0] = k + 1
                for a, b, _ in _pairs(batch, i, True):
                    before, after = cls[a], cls[b]
                    bigrams += np.bincount(before * g + after, minlength=g * g)
                    if bigrams_only:
                        continue
                    u, v = own[a], own[b]
                    x = v >= 0
                    acc += np.bincount(v[x] * 2 * g + before[x], minlength=len(acc))
                    x = u >= 0
                    acc += np.bincount(u[x] * 2 * g + g + after[x], minlength=len(acc))
                    double += np.bincount(u[x & (u == v)], minlength=m)
        v = np.c_[acc.reshape(m, 2 * g), double]
        some = np.flatnonzero(v.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, some].astype(np.int32)), binary([bigrams.tobytes(), *(v[w].tobytes() for w in some)])],
            names=["w", "v"])
    return run


def _added(batches):
    """Vectors that arrive sorted by word -> one sum for each word."""
    at, total = None, None
    for batch in batches:
        out = []
        for w, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if w != at:
                if at is not None:
                    out.append((at, total.tobytes()))
                at, total = w, np.zeros(len(v) // 8, np.int64)
            total += np.frombuffer(v, np.int64)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), binary(x for _, x in out)],
                                             names=["w", "v"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), binary([total.tobytes()])], names=["w", "v"])


def move(m: np.ndarray, k: int, own: int, left: np.ndarray, right: np.ndarray, double: int) -> int:
    """Best of the first ``k`` classes for a word now in class ``own``; ``m``, the
    class bigrams, follows the move. ``left`` and ``right`` count its neighbours."""
    left, right = left.astype(np.float64), right.astype(np.float64)
    left[own] -= double
    right[own] -= double
    m[:, own] -= left
    m[own, :] -= right
    m[own, own] -= double
    c = left.sum() + double, right.sum() + double
    rows, cols = (m.sum(1) + left)[:k], (m.sum(0) + right)[:k]      # sizes of the classes without the word
    h = np.arange(k)
    after, before = m[:k] + right, m[:, :k].T + left       # row h: the word's neighbours added to class h
    gain = (_f(after) - _f(m[:k])).sum(1) + (_f(before) - _f(m[:, :k].T)).sum(1)
    # a class's bigram with itself gets both sides and the doubles at once
    self0, l0, r0 = m[h, h], left[:k], right[:k]
    gain += _f(self0 + l0 + r0 + double) + _f(self0) - _f(self0 + r0) - _f(self0 + l0)
    gain -= _f(cols + c[0]) - _f(cols) + _f(rows + c[1]) - _f(rows)
    best = int(gain.argmax())
    m[:, best] += left
    m[best, :] += right
    m[best, best] += double
    return best


def _moves(shared, k: int):
    """Summed vectors -> ``(w, cls)`` after the words of the task were moved."""
    g = k + 2

    def run(batches):
        classes, bigrams = shared.value
        m = bigrams.astype(np.float64)
        for batch in batches:
            out = []
            for w, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(v, np.int64)
                out.append(move(m, k, int(classes[w]), v[:g], v[g:2 * g], int(v[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["w", "cls"])
    return run


def _rare_contexts(shared, k: int):
    """Blocks -> ``(word, v)`` for the words that are not frequent: the classes
    next to them and how often, packed."""
    g = k + 2

    def run(batches):
        frequent, classes = shared.value
        frequent = binary(frequent)
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                own = _numbers_of(words, frequent)
                cls = classes[own]      # the last one stands for all other words
                cls[0] = k + 1
                rare = own < 0
                rare[0] = False
                keys = []
                for a, b, _ in _pairs(batch, i, True):
                    x, y = rare[b], rare[a]
                    keys += [b[x] * np.int64(2 * g) + cls[a][x], a[y] * np.int64(2 * g) + g + cls[b][y]]
                key, n = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_counts=True)
                if not len(key):
                    continue
                packed = np.empty(len(key), _PAIR)
                packed["at"], packed["n"] = key % (2 * g), n
                word, first = np.unique(key // (2 * g), return_index=True)
                ends = np.r_[first, len(key)] * _PAIR.itemsize
                for s in range(0, len(word), 1 << 16):
                    e = min(s + (1 << 16), len(word))
                    body = packed[ends[s] // _PAIR.itemsize:ends[e] // _PAIR.itemsize].tobytes()
                    v = pa.Array.from_buffers(pa.binary(), e - s, [
                        None, pa.py_buffer((ends[s:e + 1] - ends[s]).astype(np.int32)), pa.py_buffer(body)])
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(word[s:e])), v], names=["word", "v"])
    return run


def _packed(v: pa.Array):
    """All packed counts of a binary column, and how many each value holds."""
    ends = np.frombuffer(v.buffers()[1], np.int32)[v.offset:v.offset + len(v) + 1]
    return (np.frombuffer(v.buffers()[2], _PAIR, int(ends[-1] - ends[0]) // _PAIR.itemsize, int(ends[0])),
            np.diff(ends) // _PAIR.itemsize)


def _rare_moves(shared, k: int):
    """Packed counts that arrive sorted by word -> ``(word, c, cls)``. The gain of
    a class changes at the word's own neighbours only."""
    g = k + 2

    def best(tables, group, at, n, words):
        base, was, rows, cols, near, size = tables
        key, inv = np.unique(group * (2 * g) + at, return_inverse=True)
        n = np.bincount(inv, weights=n)
        group, at = key // (2 * g), key % (2 * g)
        gain = np.zeros((words, k + 1))
        for s in range(0, len(key), ENTRIES):
            x = slice(s, s + ENTRIES)
            first = np.flatnonzero(np.r_[True, np.diff(group[x]) != 0])
            delta = near[np.minimum(n[x], len(near) - 1).astype(np.int64), at[x]]
            big = n[x] >= len(near)
            delta[big] = _f(base[at[x][big]] + n[x][big, None]) - was[at[x][big]]
            gain[group[x][first]] += np.add.reduceat(delta, first)
        c = np.bincount(group[at >= g], weights=n[at >= g], minlength=words)
        for s in range(0, words, ENTRIES):
            x = slice(s, s + ENTRIES)
            loss = size[np.minimum(c[x], len(size) - 1).astype(np.int64)]
            big = c[x] >= len(size)
            loss[big] = _f(cols + c[x][big, None]) - _f(cols) + _f(rows + c[x][big, None]) - _f(rows)
            gain[x] -= loss
        return c.astype(np.int64), gain.argmax(1).astype(np.int32)

    def prepared():
        """The class bigrams next to each neighbour, and what small counts change."""
        m = shared.value.astype(np.float64)
        base = np.concatenate([m[:, :k + 1], m[:k + 1].T])      # row: neighbour's side and class; column: class
        was, rows, cols = _f(base), m.sum(1)[:k + 1], m.sum(0)[:k + 1]
        return (base, was, rows, cols, np.stack([_f(base + i) - was for i in range(9)]),
                np.stack([_f(cols + i) - _f(cols) + _f(rows + i) - _f(rows) for i in range(65)]))

    def run(batches):
        tables = prepared()
        word, at, n = binary([]), np.empty(0, np.int64), np.empty(0)     # the last word may go on in the next batch

        def done(words, group, at, n):
            c, cls = best(tables, group, at, n, len(words))
            return pa.RecordBatch.from_arrays([words, pa.array(c), pa.array(cls)], names=["word", "c", "cls"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.concat_arrays([word, batch.column(0).cast(pa.binary())])
            flat, sizes = _packed(batch.column(1).cast(pa.binary()))
            fresh = np.r_[True, pc.not_equal(new[1:], new[:-1]).to_numpy(zero_copy_only=False)].astype(bool)
            number = np.cumsum(fresh) - 1
            at, n = np.r_[at, flat["at"]], np.r_[n, flat["n"]]
            group = np.r_[np.zeros(len(at) - len(flat), np.int64), np.repeat(number[len(word):], sizes)]
            distinct = new.filter(pa.array(fresh))
            last = np.searchsorted(group, number[-1])
            if last:
                yield done(distinct[:-1], group[:last], at[:last], n[:last])
            sums = np.bincount(at[last:].astype(np.int64), weights=n[last:], minlength=2 * g)
            word, at = distinct[-1:], np.flatnonzero(sums)
            n = sums[at]
        if len(word):
            yield done(word, np.zeros(len(at), np.int64), at, n)
    return run


def _local(batch: pa.RecordBatch, i: int, unknown: int):
    """Count and class of every word of row ``i``."""
    c = np.zeros(len(batch.column("words")[i].values), np.int64)
    cls = np.full(len(c), unknown)
    place = batch.column("place")[i]
    if place.is_valid:
        place = place.values.to_numpy()
        at = place >> 16
        c[at], cls[at] = batch.column("c")[i].values.to_numpy(), place & 0xFFFF
    return c, cls


def _class_bigrams(k: int):
    g = k + 3

    def run(batches):
        m = np.zeros(g * g, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                c, cls = _local(batch, i, g - 1)
                for a, b, _ in _pairs(batch, i, True):
                    x, y = cls[a], cls[b]
                    m += np.bincount(x * g + y, minlength=g * g)
                    once = c[b] == 1
                    m += np.bincount(x[once] * g + g - 1, minlength=g * g)
                    once = c[a] == 1
                    m += np.bincount((g - 1) * g + y[once], minlength=g * g)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at])], names=["at", "n"])
    return run


def _scores(shared):
    def run(batches):
        bigrams, sizes, prior, tokens, types = shared.value
        g = len(sizes)
        share = sizes / sizes.sum()
        with np.errstate(divide="ignore"):
            step = np.log10((bigrams + prior * share) / (bigrams.sum(1) + prior)[:, None])
        for batch in batches:
            for i in range(batch.num_rows):
                c, cls = _local(batch, i, g - 1)
                word = np.where(cls < g - 1, np.log10((c + 1) / np.maximum(sizes[cls], 1)), 0.0)
                base = np.log10((c + 1) / (tokens + 1 * (types + 1)))
                col = lambda name: batch.column(name)[i].values
                for a, b, part in _pairs(batch, i, False):
                    first = np.flatnonzero(np.r_[True, np.diff(part) != 0])
                    add = lambda x: pa.array(np.add.reduceat(x, first))
                    own = pa.array(part[first])
                    yield pa.RecordBatch.from_arrays(
                        [col("rows").take(own), col("ids").take(own), col("held").take(own), add(np.ones(len(b), np.int64)),
                         add((c[b] > 0).astype(np.int64)), add(base[b]), add(step[cls[a], cls[b]] + word[b])],
                        names=["row", "id", "held", "n_tokens", "n_known", "base", "score"])
    return run


def encode(df: DataFrame, id_col: str, text_col: str, held, made: list[str]) -> DataFrame:
    """The blocks of the texts, written as a table bucketed by block."""
    src = df.select(F.col(id_col).alias("id"), held.alias("held"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type
    blocks = src.mapInArrow(_blocks(to_arrow_type(src.schema["id"].dataType)),
                            f"block long, ids array<{kind}>, rows array<long>, held array<boolean>, size array<int>, "
                            "low binary, high array<int>, words array<binary>, n array<int>")
    return bucketed_table(blocks, "block", _buckets(df), "lm-blocks", made)


def train(blocks: DataFrame, classes: int = 64, frequent: int = 8192, sweeps: int = 4) -> Model:
    """Learn the classes of all words of the training texts."""
    spark = blocks.sparkSession
    k = classes
    counts = cut(blocks.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select("x.words", "x.n").where("n > 0")
                 .groupBy(F.col("words").alias("word")).agg(F.sum("n").alias("c")))
    tokens, types, end = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.length("word") == 0, F.col("c")))).first()
    top = counts.where(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(frequent).collect()     # at most `frequent`
    most = [bytes(r["word"]) for r in top]
    now = np.arange(len(top)) % k
    seen, tried = [], []
    parts_ = _buckets(blocks)
    read = blocks.select("held", "size", "low", "high", "words")
    for sweep in range(max(sweeps, 1)):
        last = sweep == max(sweeps, 1) - 1
        shared = spark.sparkContext.broadcast((most, np.r_[now, k]))
        sums = cut(read.mapInArrow(_contexts(shared, k, last), "w int, v binary").repartition(parts_, "w")
                   .sortWithinPartitions("w").mapInArrow(_added, "w int, v binary"))
        m = sums.where("w = -1").first()
        m = np.frombuffer(bytes(m["v"]), np.int64).reshape(k + 2, k + 2) if m else np.zeros((k + 2, k + 2), np.int64)
        seen.append(likelihood(m.astype(np.float64)))
        tried.append((now, m))
        if last:
            break
        share = spark.sparkContext.broadcast((now, m))
        now = now.copy()
        for w, c in sums.where("w >= 0").mapInArrow(_moves(share, k), "w int, cls int").collect():    # at most `frequent`
            now[w] = c
    now, m = tried[int(np.argmax(seen))]
    shared, share = spark.sparkContext.broadcast((most, np.r_[now, k])), spark.sparkContext.broadcast(m)
    rare = (read.mapInArrow(_rare_contexts(shared, k), "word binary, v binary").repartition(parts_, "word")
            .sortWithinPartitions("word").mapInArrow(_rare_moves(share, k), "word binary, c long, cls int"))
    known = [(bytearray(r["word"]), r["c"], int(now[i])) for i, r in enumerate(top)]
    if end:
        known.append((bytearray(END), end, k + 1))
    words = cut(rare.unionByName(spark.createDataFrame(known, "word binary, c long, cls int")))
    return Model(words, tokens or 0, types, k, np.zeros((k + 3, k + 3), np.int64), seen)


def lookup(blocks: DataFrame, model: Model, made: list[str]) -> DataFrame:
    """``(block, place, c)``: place and class as one number, and count, of the known
    words of a block, written as a table bucketed like the blocks. Two lists of
    numbers: structs took 40 bytes a word, these take 16."""
    pairs = blocks.select("block", F.posexplode("words").alias("i", "word")).join(
        model.words.hint("shuffle_hash"), "word").select(       # its words are distinct
        "block", (F.col("i").cast("long") * 65536 + F.col("cls")).alias("place"), "c")
    return bucketed_table(pairs.repartition(_buckets(blocks), "block").groupBy("block").agg(
        F.collect_list("place").alias("place"), F.collect_list("c").alias("c")), "block", _buckets(blocks), "lm-known", made)


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def score(df: DataFrame, id_col: str, text_col: str, held, classes: int = 64, frequent: int = 8192,
          sweeps: int = 4, prior: float = 10.0, stats: list | None = None) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)``,
    one row per row of ``df``. ``held``: a condition; rows that meet it are scored
    but not learned from. Words are runs of bytes other than \\x20 and \\x09-\\x0D,
    A-Z lower-cased; every text has one more token, its end. Null texts count as
    empty, null conditions as false, ids may be null or repeat. Without training
    texts all tokens are unknown and every score is 0. Long texts are cut into
    parts behind white space. Other columns are not read. ``stats`` receives the model."""
    spark = df.sparkSession
    ready(spark)
    made: list[str] = []
    with shuffles_dropped(spark):       # else the shuffles of all sweeps stay until the end
        blocks = encode(df, id_col, text_col, F.coalesce(held, F.lit(False)), made)
        model = train(blocks, classes, frequent, sweeps)
        known = lookup(blocks, model, made)
        g = classes + 3
        both = lambda *cols: blocks.select("block", "held", "size", "low", "high", "words", *cols).join(known, "block", "left").drop("block")
        for at, n in both().mapInArrow(_class_bigrams(classes), "at long, n long").groupBy("at").agg(F.sum("n")).collect():
            model.bigrams[at // g, at % g] = n      # at most g * g rows
        sizes = np.zeros(g, np.int64)
        sizes[g - 1] = 1
        for cls, n, once in model.words.groupBy("cls").agg(F.sum(F.col("c") + 1), F.count(F.when(F.col("c") == 1, 1))).collect():
            sizes[cls] = n
            sizes[g - 1] += once
        if stats is not None:
            stats.append((model, sizes))
        shared = spark.sparkContext.broadcast((model.bigrams, sizes, prior, model.tokens, model.types))
        kind = df.schema[id_col].dataType.simpleString()
        out = both("rows", "ids").mapInArrow(
            _scores(shared), f"row long, id {kind}, held boolean, n_tokens long, n_known long, base double, score double")
        out = cut(out.groupBy("row").agg(
            F.first("id").alias(id_col), F.first("held").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
            F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("row"))
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out
