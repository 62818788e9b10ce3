"""Python string semantics as native column expressions.

``str.strip()`` / ``str.split()`` use the Unicode whitespace set of
``str.isspace()``; Spark's ``trim`` and Java's ``\\s`` do not, so the class is
spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points for which Python's str.isspace() is true,
# as a Java regex character class.
PY_WS = (r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# The same class for DuckDB (RE2) in oracle SQL.
PY_WS_SQL = (r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``. The look-behind lets a run of white space inside the
    text be tried once only, not again from each of its characters."""
    return F.regexp_replace(_col(c), f"^{PY_WS}+|(?<!{PY_WS}){PY_WS}+\\z", "")


def py_split(c) -> Column:
    """``str.split()`` with no argument: no empty tokens."""
    return F.filter(F.split(_col(c), f"{PY_WS}+"), lambda t: t != F.lit(""))


def token_set(c) -> Column:
    """``set(text.split())`` as a distinct array."""
    return F.array_distinct(py_split(c))


def normalize_newlines(c) -> Column:
    """Text-mode read: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def sql_strip(expr: str) -> str:
    """DuckDB form of :func:`py_strip` for oracle SQL."""
    return f"regexp_replace({expr}, '^{PY_WS_SQL}+|{PY_WS_SQL}+$', '', 'g')"


def sql_tokens(expr: str) -> str:
    """DuckDB form of :func:`py_split` (unnest-able list)."""
    return f"list_filter(regexp_split_to_array({expr}, '{PY_WS_SQL}+'), lambda x: x <> '')"
