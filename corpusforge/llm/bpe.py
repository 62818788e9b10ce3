"""Byte-level BPE encoding and decoding (operator 8).

Encoding replays the merge table over a slice of the corpus at once: the
distinct words of the slice are laid out as one sequence of byte tokens, an
inverted index holds the positions of every mergeable pair, and the pairs are
merged in rank order. A merge touches its two neighbours only. (In a trained
table a token's parts have lower ranks than the token, so a merge never makes a
pair that should have come earlier.) Words do not
interact, so a slice gives the same ids as the whole corpus would, and no
table of all words has to be shuffled or broadcast. A task keeps the words it
has met, up to ``CACHE`` of them, so later slices replay new words only.

Decoding looks the ids' bytes up and joins them.
"""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import chunks, ready, slices

CACHE = 150_000         # words a task remembers
CHUNK = 1 << 20         # bytes encoded or decoded at a time
SCAN = 1 << 19          # characters split into words at a time

#: Fixed value: the split pattern that `Splitter` follows without a regex engine.
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


class Splitter:
    """Splits many texts at once; arrays of word keys instead of word strings.

    For ``PATTERN`` the words are found from runs of character classes
    (letter, number, white space, other); any other pattern is matched by
    ``regex``. White space is Unicode's property."""

    def __init__(self, pattern: str):
        import regex
        self.regex = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.kind = None
        if pattern == PATTERN:
            self.kind = np.full(0x110000, 2, np.uint8)
            for low in range(0, 0x110000, 0x800):       # in blocks, as a string of all is large
                if not 0xD800 <= low < 0xE000:
                    block = "".join(map(chr, range(low, low + 0x800)))
                    for k, prop in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\p{White_Space}+")):
                        for m in regex.finditer(prop, block):
                            self.kind[low + m.start():low + m.end()] = k
        rng = np.random.default_rng(11)
        self.mul = [int(x) | 1 for x in rng.integers(1 << 62, 1 << 63, 2, dtype=np.int64)]
        n = SCAN + 1
        self.up = [np.cumprod(np.r_[np.uint64(1), np.full(n, m, np.uint64)]) for m in self.mul]
        self.down = [np.cumprod(np.r_[np.uint64(1), np.full(n, pow(m, -1, 2 ** 64), np.uint64)]) for m in self.mul]

    def starts(self, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Word starts among code points ``c``; ``doc``: starts of texts."""
        kind, n = self.kind[c], len(c)
        fresh = np.zeros(n + 1, bool)
        fresh[doc] = fresh[n] = True
        run = fresh[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        white = kind == 3
        # the last white-space character before a word stands by itself, or is
        # a space and belongs to the word
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~fresh[1:n])
        start[last] = True
        start[last[c[last] == 32] + 1] = False
        tick = np.flatnonzero((c[:-1] == 39) & start[:-1] & (kind[1:] == 0) & ~fresh[1:n])
        if len(tick):
            one = c[tick + 1]
            two = np.where((tick + 2 < n) & ~fresh[np.minimum(tick + 2, n)], c[np.minimum(tick + 2, n - 1)], 0)
            size = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
            for x, y in ((114, 101), (118, 101), (108, 108)):
                size[(one == x) & (two == y)] = 3
            tick, size = tick[size > 0], size[size > 0]
            start[tick + 1] = False
            after = tick + size
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def words(self, texts: list[str]):
        """``(counts, keys, checks, word(i))``: words per text, two independent
        64-bit hashes of every word, and a function that gives word ``i``."""
        counts, parts = [], []
        group: list[str] = []
        if self.kind is None or any(len(t) > SCAN for t in texts):
            found = [self.regex.findall(t) for t in texts]
            flat = [w for ws in found for w in ws]
            size = np.array([len(w) for w in flat], np.int64)
            for i, j in chunks(size, SCAN):
                big = size[i] > SCAN        # a word longer than the tables: its own digest
                if big:
                    import hashlib
                    d = np.frombuffer(hashlib.blake2b(flat[i].encode(), digest_size=16).digest(), np.uint64)
                    parts.append((d[:1], d[1:]))
                else:
                    c = np.frombuffer("".join(flat[i:j]).encode("utf-32-le"), np.uint32)
                    parts.append(self._hash(c, np.r_[0, np.cumsum(size[i:j])]))
            word = flat.__getitem__
            counts = [len(ws) for ws in found]
        else:
            joined, at, offs = [], 0, []
            for i, j in chunks([len(t) for t in texts], SCAN):
                group = texts[i:j]
                line = "".join(group)
                c = np.frombuffer(line.encode("utf-32-le"), np.uint32)
                size = np.array([len(t) for t in group])
                doc = np.r_[0, np.cumsum(size)]
                s = self.starts(c, doc[:-1][size > 0]) if len(c) else np.empty(0, np.int64)
                counts += np.diff(np.searchsorted(s, doc)).tolist()
                parts.append(self._hash(c, np.r_[s, len(c)]))
                offs.append(np.c_[s, np.r_[s[1:], len(c)][:len(s)]] + at)
                joined.append(line)
                at += len(line)
            whole = "".join(joined)
            offs = np.concatenate(offs) if offs else np.empty((0, 2), np.int64)
            word = lambda i: whole[offs[i, 0]:offs[i, 1]]
        if not parts:
            return np.array(counts, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), word
        keys, checks = (np.concatenate(x) for x in zip(*parts))
        return np.array(counts, np.int64), keys, checks, word

    def _hash(self, c: np.ndarray, ends: np.ndarray):
        out = []
        x = (c.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        for up, down in zip(self.up, self.down):
            pre = np.r_[np.uint64(0), np.cumsum(x * up[:len(c)])]
            h = (pre[ends[1:]] - pre[ends[:-1]]) * down[ends[:-1]]
            out.append((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93))
        return tuple(out)


class Vocabulary:
    """Rank file of lines ``base64(bytes) rank``; the rank is the id."""

    def __init__(self, data: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        self.split = Splitter(pattern)
        self.bytes = byte_table(data)
        self.byte = np.array([self.rank[bytes((i,))] for i in range(256)], np.int64)
        # every pair of tokens that makes a token, sorted
        made = sorted((self.rank[b[:i]] << 32 | self.rank[b[i:]], r) for b, r in self.rank.items()
                      for i in range(1, len(b)) if b[:i] in self.rank and b[i:] in self.rank)
        self.pairs, self.pair_rank = (np.array(x, np.int64) for x in zip(*made, (1 << 62, -1)))
        self.forget()

    def forget(self) -> None:
        """Words met so far: sorted keys, checks, and where their ids are."""
        self.keys = np.empty(0, np.uint64)
        self.checks, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens, or -1."""
        key = a << 32 | b
        i = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[i] == key, self.pair_rank[i], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, joined, and their number for each word. ``index``
        maps a rank to the positions of its pairs."""
        size = np.array([len(w) for w in words], np.int64)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tok)
        ends = np.cumsum(size)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)    # one spare place: no neighbour
        nxt[ends[size > 0] - 1], prv[(ends - size)[size > 0]] = n, n
        tok = np.r_[tok, -1]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[(at < n) & (nxt[at] < n)]
            r = self._ranks(tok[at], tok[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for x, part in zip(r[cut].tolist(), np.split(at, cut[1:])):
                if x not in index:
                    index[x] = []
                    heapq.heappush(heap, x)
                index[x].append(part)

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            i = index.pop(r)
            i = np.unique(np.concatenate(i)) if len(i) > 1 else i[0]
            i = i[(tok[i] >= 0) & (nxt[i] < n)]         # stale: merged before
            i = i[self._ranks(tok[i], tok[nxt[i]]) == r]
            if not len(i):
                continue
            if len(i) > 1 and np.isin(nxt[i], i).any():
                # overlapping places ("aaa"): the leftmost of a chain goes first
                taken, free = [], -1
                for x, y in zip(i.tolist(), nxt[i].tolist()):
                    if x != free:
                        taken.append(x)
                        free = y
                i = np.array(taken)
            j = nxt[i]
            after = nxt[j]
            tok[i], tok[j], nxt[i] = r, -1, after
            prv[after] = i
            add(np.concatenate([prv[i], i]))
        left = tok[:n] >= 0
        word = np.repeat(np.arange(len(words)), size)
        return tok[:n][left].astype(np.int32), np.bincount(word[left], minlength=len(words))

    def learn(self, words: list[str], keys: np.ndarray, checks: np.ndarray) -> None:
        raw = [w.encode() for w in words]
        known = np.array([self.rank.get(b, -1) for b in raw], np.int64)
        rest = np.flatnonzero(known < 0)
        ids, count = self.replay([raw[i] for i in rest])
        size = np.ones(len(words), np.int64)
        size[rest] = count
        at = np.cumsum(size) - size
        new = np.empty(int(size.sum()), np.int32)
        new[at[known >= 0]] = known[known >= 0]
        new[np.repeat(at[rest] - (np.cumsum(count) - count), count) + np.arange(len(ids))] = ids
        at += len(self.ids)
        self.ids = np.concatenate([self.ids, new])
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.checks, self.at, self.size = (
            np.concatenate(x)[order] for x in ((self.keys, keys), (self.checks, checks), (self.at, at), (self.size, size)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and their number for each text. A text
        over ``SCAN`` characters is encoded in parts."""
        if self.split.kind is None or all(len(t) <= SCAN for t in texts):
            return self._encode(texts)
        out, count = [], []
        for t in texts:
            ids = [self._encode([part])[0] for part in _parts(t)]
            out += ids
            count.append(sum(map(len, ids)))
        return np.concatenate([np.empty(0, np.int32), *out]), np.array(count, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, keys, checks, word = self.split.words(texts)
        one, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if not np.array_equal(checks[first][back], checks):
            return self._plain(texts)

        def unknown():
            i = np.minimum(np.searchsorted(self.keys, one), max(len(self.keys) - 1, 0))
            return np.flatnonzero(self.keys[i] != one) if len(self.keys) else np.arange(len(one))

        new = unknown()
        if len(self.keys) + len(new) > CACHE:
            self.forget()
            new = unknown()
        if len(new):
            self.learn([word(i) for i in first[new].tolist()], one[new], checks[first[new]])
        i = np.searchsorted(self.keys, one)
        if not np.array_equal(self.checks[i], checks[first]):
            return self._plain(texts)
        at, size = self.at[i][back], self.size[i][back]
        ids = self.ids[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]
        return ids, np.diff(ends)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the words themselves, for texts in which two words share
        a 64-bit key."""
        words = [self.split.regex.findall(t) for t in texts]
        place = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        ids, size = self.replay([w.encode() for w in place])
        known = np.split(ids, np.cumsum(size)[:-1]) if len(size) else []
        out = [np.concatenate([np.empty(0, np.int32), *(known[place[w]] for w in ws)]) for ws in words]
        return np.concatenate([np.empty(0, np.int32), *out]), np.array([len(x) for x in out], np.int64)


def _parts(text: str):
    """A text in parts of about half of ``SCAN``, cut before a space between
    two ASCII letters, where a word of ``PATTERN`` starts in any case."""
    at = 0
    while len(text) - at > SCAN:
        m = _CUT.search(text, at + SCAN // 2)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_LOADED: dict[tuple[int, str], Vocabulary] = {}


def byte_table(data: bytes) -> pa.Array:
    """The bytes of every id, null where the rank file has none."""
    of = {int(b): base64.b64decode(a) for a, b in (x.split() for x in data.splitlines() if x)}
    return pa.array([of.get(i) for i in range(max(of, default=-1) + 1)], pa.binary())


def _vocabulary(ranks, pattern: str) -> Vocabulary:
    key = (hash(ranks.value), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(ranks.value, pattern)
    return _LOADED[key]


def _lists(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids))


def _share(spark, ranks_path: str):
    """The rank file (fixed size) is read where the job starts and sent along."""
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str,
           keep: list[str] = (), decoded: str | None = None) -> DataFrame:
    """``(id_col, *keep, ids array<int>)``, one row per row. Each match of
    ``pattern`` is encoded by itself, without special tokens; null and empty
    texts have no ids. With ``decoded`` a last column of that name holds the
    bytes that the ids decode to, from the same pass over the texts."""
    ready(df.sparkSession)
    ranks = _share(df.sparkSession, ranks_path)
    names = [id_col, *keep, "ids", *([decoded] if decoded else [])]
    if len(set(names)) < len(names):
        raise ValueError(f"columns repeat a name: {names}")
    src = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), id_col, *keep)

    def run(batches):
        vocab = _vocabulary(ranks, pattern)
        for part in (part for b in batches for part in slices(b, 0, CHUNK)):
            ids = _lists(*vocab.encode(part.column(0).to_pylist()))
            more = [_joined_bytes(vocab.bytes, ids)] if decoded else []
            yield pa.RecordBatch.from_arrays([*part.columns[1:], ids, *more], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, f"{fields}, ids array<int>" + (f", `{decoded}` binary" if decoded else ""))


def _joined_bytes(table: pa.Array, ids: pa.Array) -> pa.Array:
    """Per list of ids the joined bytes; null for null."""
    got = table.take(ids.flatten())
    if got.null_count:
        raise ValueError("an id is not in the rank file")
    ends = np.r_[0, np.cumsum(pc.binary_length(got).to_numpy(zero_copy_only=False), dtype=np.int64)]
    count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    cuts = ends[np.r_[0, np.cumsum(count, dtype=np.int64)]]
    body = got.buffers()[2] if len(got) else pa.py_buffer(b"")
    if not ids.null_count:      # the bytes already lie one behind the other
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cuts.astype(np.int32)), body])
    whole, at = body.to_pybytes(), cuts.tolist()
    return pa.array([None if g else whole[a:b] for g, a, b in zip(ids.is_null().to_pylist(), at, at[1:])], pa.binary())


def decode(df: DataFrame, id_col: str, ids_col: str, ranks_path: str) -> DataFrame:
    """``(id_col, ids, bytes)``, one row per row: the joined bytes of the ids.
    Null gives null; an id outside the table is an error."""
    ready(df.sparkSession)
    ranks = _share(df.sparkSession, ranks_path)
    src = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        table = byte_table(ranks.value)
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist()
            for i, j in chunks(size, CHUNK // 4):
                ids = batch.column(1).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids, _joined_bytes(table, ids)],
                                                 names=["id", "ids", "bytes"])

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ids array<int>, bytes binary").withColumnRenamed("id", id_col)
