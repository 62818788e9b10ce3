"""Per-row Python-source helpers. They run inside Arrow batches
(``mapInPandas`` / pandas UDFs) and use CPython's own ``ast``; Spark does
the partitioning and everything around them.

Nothing here executes the input text.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple

# Node types counted by the grading rule.
STMT_NODES = frozenset((ast.Assign, ast.If, ast.For, ast.While, ast.FunctionDef, ast.Return))
BRANCH_NODES = frozenset((ast.If, ast.For, ast.While, ast.Try))

# Fields that hold statements, in the order of every node's own fields. A
# function is a statement, so nothing else needs to be looked into for one.
BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")

MIN_SNIPPET_CHARS = 25  # a snippet is kept when its stripped length exceeds this


def parse(src: str):
    """``(tree, status)``; status is ``ok`` or the failure kind. Hostile text
    (NUL bytes, deep nesting, huge input) never raises."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(src), "ok"
        except SyntaxError:
            return None, "syntax_error"
        except ValueError:
            return None, "value_error"
        except RecursionError:
            return None, "recursion_error"
        except MemoryError:
            return None, "memory_error"


def node_counts(tree) -> tuple[int, int, int]:
    """C1 of ``tree``; a function's decorators are not part of its text, so
    those of ``tree`` itself do not count."""
    stmts = calls = branches = 0
    todo = [tree]
    for n in todo:      # grows while it is read
        kind = type(n)
        stmts += kind in STMT_NODES
        calls += kind is ast.Call
        branches += kind in BRANCH_NODES
        for name, value in vars(n).items():
            if isinstance(value, ast.AST):
                todo.append(value)
            elif isinstance(value, list) and not (n is tree and name == "decorator_list"):
                todo += [x for x in value if isinstance(x, ast.AST)]
    return stmts, calls, branches


class FunctionSpan(NamedTuple):
    """A synchronous ``def`` in the file text: ``text[start:end]`` runs from the
    first character of its line to the end of its last line."""

    node: ast.FunctionDef
    start: int
    end: int


def function_spans(text: str, tree) -> Iterator[FunctionSpan]:
    """Spans of all functions, one nesting level of the tree after the other."""
    newline = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    begin = [0, *(at + 1 for at in newline)]
    level = [tree]
    while level:
        for node in level:
            if isinstance(node, ast.FunctionDef):
                yield FunctionSpan(node, begin[node.lineno - 1], newline[node.end_lineno - 1])
        level = [child for node in level for name in BLOCKS
                 if isinstance(block := getattr(node, name, None), list) for child in block]


def parses_alone(span: FunctionSpan, text: str, top: bool = False):
    """Tree of the function's own text, or None. A ``def`` behind spaces or tabs
    is an unexpected indent, which needs no parser to tell. A ``def`` at the
    start of a line and of the module (``top``), with nothing but a comment behind
    its end, has the same tree alone, without its decorators; lone carriage
    returns (lines of Python, not of the text) and the one import that changes
    the grammar are left to the parser."""
    code = text[span.start:span.end]
    raw = code.encode()
    before = raw[:span.node.col_offset].rsplit(b"\f", 1)[-1]
    if before and not before.strip(b" \t"):
        return None
    if top and not span.node.col_offset and code.startswith("def"):
        at = 0 if span.node.lineno == span.node.end_lineno else raw.rindex(b"\n") + 1
        behind = raw[at + span.node.end_col_offset:].strip(b" \t")
        if not behind or behind.startswith(b"#"):
            return span.node
    return parse(code)[0]


def extract_functions(code: str):
    """P2-P4 + C1 for one file: ``(status, rows)`` with rows ``(fn_ord, lineno,
    name, snippet, docstring, snippet_parses, stmts, calls, branches)``.
    ``fn_ord`` numbers all functions; those whose text has no more than 25
    characters without the white space around it give no row. The counts are
    those of the function's text parsed alone (None if it does not parse)."""
    tree, status = parse(code)
    rows = []
    plain = tree and "\r" not in code and "barry_as_FLUFL" not in code
    top = set(tree.body) if plain else ()
    for fn_ord, span in enumerate(function_spans(code, tree) if tree else ()):
        snippet = code[span.start:span.end]
        if len(snippet.strip()) <= MIN_SNIPPET_CHARS:
            continue
        alone = parses_alone(span, code, span.node in top)
        counts = node_counts(alone) if alone else (None, None, None)
        rows.append((fn_ord, span.node.lineno, span.node.name, snippet,
                     ast.get_docstring(span.node) or "", alone is not None, *counts))
    return status, rows


def function_shape(src: str) -> tuple[bool, int]:
    """R3's parse half: ``(parses, number of synchronous defs anywhere)``."""
    tree, _ = parse(src)
    if tree is None:
        return False, 0
    return True, sum(isinstance(n, ast.FunctionDef) for n in ast.walk(tree))
