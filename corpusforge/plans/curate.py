"""End-to-end curation: source files -> task, preference and count tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from corpusforge.operators.dedup import near_dedup
from corpusforge.operators.extract import (extract_function_rows, quarantined_files,
                                           valid_functions)
from corpusforge.session import cut_lineage
from corpusforge.operators.tasks import (KEYWORD, TASK_PREFIX, difficulty_counts,
                                         keyword_filter, number_functions,
                                         preference_rows, task_rows)


@dataclass
class Curated:
    tasks: DataFrame          # deduplicated task rows (TASKS / TASKS_VARIANT + task_no)
    preferences: DataFrame    # (prompt, chosen, rejected)
    difficulty: DataFrame     # (difficulty_scale, count)
    quarantine: DataFrame     # files that did not parse: (repo, path, status)


def curate(files: DataFrame, keyword: str | None = KEYWORD, variant: bool = False,
           threshold: float = 0.95, prefix: str = TASK_PREFIX) -> Curated:
    """``files(repo, path, status, content STRING)`` -> curated tables.

    P1 runs before the Python boundary so Catalyst can push it toward the
    scan; P3/P4 run right after it. Functions are numbered before dedup (the
    numbers keep their gaps), then D1 + D2 run in that order."""
    if keyword is not None:
        files = keyword_filter(files, keyword)
    fns = cut_lineage(extract_function_rows(files))      # one Python pass per file
    numbered = number_functions(valid_functions(fns), prefix, materialize=False)
    tasks = task_rows(numbered, variant=variant, keep_order=True)
    kept = near_dedup(tasks, "task_no", "canonical_solution", threshold)
    return Curated(tasks=kept,
                   preferences=preference_rows(kept),
                   difficulty=difficulty_counts(kept),
                   quarantine=quarantined_files(fns))
