"""Words of texts as numbers; shared by operators 11 to 13."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: ``[^\x20\x09-\x0D]+`` on UTF-8 bytes is what ``bytes.split()`` finds.
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def parts(raw: bytes, limit: int, cut: re.Pattern = SPACE):
    """``raw`` in slices of about ``limit`` bytes, each cut behind a separator.
    Bytes without one stay together."""
    at = 0
    while len(raw) - at > limit:
        m = cut.search(raw, at + limit - 1)
        if not m:
            break
        yield raw[at:m.end()]
        at = m.end()
    yield raw[at:]


class Numbers(dict):
    """Numbers for words, in the order they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def binary(words) -> pa.Array:
    return pa.array(list(words), pa.binary())
