"""Function extraction (P2-P4) and syntax counts (C1) in one Python pass.

One source file in, zero or more function rows out: the role of a table
function, written as ``mapInArrow`` so rows cross the JVM/Python boundary in
Arrow batches. Each file is parsed once; a snippet is parsed again only where its
text alone may mean something else than in the file. A task takes about
``FILES`` files, however many there are, and holds the functions of ``STEP`` of them.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.pyast import extract_functions
from corpusforge.functions.text import py_strip
from corpusforge.session import ship_package, spread
from corpusforge.sources.schemas import FUNCTIONS

FILES = 10_000      # files of a task
STEP = 256          # files whose functions are held at a time

_OUT_COLS = [f.name for f in FUNCTIONS.fields]
_OUT_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(),
              pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string()]


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(s, STEP) for b in batches for s in range(0, b.num_rows, STEP)):
        out = []
        for repo, path, content in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "content"))):
            status, rows = ("no_content", ()) if content is None else extract_functions(content)
            if status != "ok":
                out.append((repo, path, *[None] * 9, status))
            out += [(repo, path, *row, "ok") for row in rows]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out), _OUT_KINDS)], names=_OUT_COLS)


def extract_function_rows(files: DataFrame) -> DataFrame:
    """``files(repo, path, content)`` -> every extracted function with the
    long-snippet rule already applied (P2, P3) and the validity flag and
    counts attached; a file that does not parse yields one row with its
    ``status`` and NULL function fields (E2 isolation, the job goes on)."""
    ship_package(files.sparkSession)
    return spread(files.select("repo", "path", "content"), FILES).mapInArrow(_extract_batches, FUNCTIONS)


def valid_functions(fns: DataFrame) -> DataFrame:
    """P3 + P4: long enough, not a ``test_`` function, parses on its own
    (so only column-0 functions survive)."""
    return fns.where(
        (F.col("status") == "ok")
        & (F.length(py_strip("code")) > 25)
        & ~F.col("name").startswith("test_")
        & F.col("snippet_parses"))


def quarantined_files(fns: DataFrame) -> DataFrame:
    """Files that could not be read as Python, with the reason."""
    return fns.where(F.col("status") != "ok").select("repo", "path", "status")
