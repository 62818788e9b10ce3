"""Word-piece token counts by a linear longest-match automaton (operator 9).

A word is spelled by the longest vocabulary piece at its start, then by the
longest continuation pieces. The automaton walks each word once: a trie holds
the pieces; where a node has no child for the next byte, its failure link leads
to the node of the bytes left after the longest pieces of its string are popped
off, and the number of those pieces is stored with the link. Counts are sums of
stored numbers; no piece is ever built. A word that cannot be spelled counts
as one unknown piece.

Failure links are computed once from the vocabulary (fixed size), breadth
first. Each task keeps the counts of up to ``CACHE`` words it has met.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import ready, slices

CACHE = 300_000


class Automaton:
    """Nodes are numbers; 0 is the start of a word, 1 of a continuation."""

    def __init__(self, first: set[bytes], later: set[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in self.next[node]:
                        self.next[node][byte] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    node = self.next[node][byte]
                whole[node] = whole[node] or bool(piece)
        # fail[v], pops[v]: the node after the longest pieces of v's string are
        # popped, and their number; -1: no piece starts the string
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for byte, v in self.next[u].items():
                    if whole[v]:
                        self.fail[v], self.pops[v] = 1, 1
                    else:
                        z, n = self.fail[u], self.pops[u]
                        while z >= 0 and byte not in self.next[z]:
                            n += self.pops[z]
                            z = self.fail[z] if z > 1 else -1
                        if z >= 0:
                            self.fail[v], self.pops[v] = self.next[z][byte], n
                    below.append(v)
            level = below

    def count(self, word: bytes) -> int:
        nxt, fail, pops = self.next, self.fail, self.pops
        node, n = 0, 0
        for byte in word:
            while byte not in nxt[node]:
                if node < 2 or fail[node] < 0:
                    return 1
                n += pops[node]
                node = fail[node]
            node = nxt[node][byte]
        while node > 1:
            if fail[node] < 0:
                return 1
            n += pops[node]
            node = fail[node]
        return n


def pieces_of(ranks: bytes) -> tuple[set[bytes], set[bytes]]:
    """Word-piece vocabulary of a rank file: tokens after a space start a word,
    tokens without a space continue one."""
    tokens = [base64.b64decode(x.split()[0]) for x in ranks.splitlines() if x]
    return ({t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and b" " not in t[1:]},
            {t for t in tokens if b" " not in t})


_LOADED: dict[int, tuple[Automaton, dict[bytes, int]]] = {}


def token_counts(df: DataFrame, id_col: str, text_col: str, ranks_path: str) -> DataFrame:
    """``(id_col, n_words, n_tokens)``, one row per row; words are runs of
    bytes other than \\x20 and \\x09-\\x0D. Null and empty texts have none."""
    ready(df.sparkSession)
    with open(ranks_path, "rb") as f:       # fixed size, read where the job starts
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    src = df.select(F.col(id_col).alias("id"), F.coalesce(
        F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        key = hash(ranks.value)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Automaton(*pieces_of(ranks.value)), {}
        automaton, known = _LOADED[key]
        for b in (part for x in batches for part in slices(x, 1, 4 << 20)):
            words, tokens = [], []
            for text in b.column(1).to_pylist():
                split = text.split()
                new = set(split).difference(known)
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = set(split)
                for w in new:
                    known[w] = automaton.count(w)
                words.append(len(split))
                tokens.append(sum(map(known.__getitem__, split)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["id", "n_words", "n_tokens"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
