"""corpusforge: code-dataset curation and scoring on Spark DataFrames."""

from corpusforge.operators.dedup import exact_dedup, near_dedup, near_dedup_status
from corpusforge.operators.evaluate import outcome_rows, summarise
from corpusforge.operators.report import box_stats, histogram, rates_long
from corpusforge.operators.tasks import preference_rows
from corpusforge.plans.curate import curate
from corpusforge.plans.score import score

__all__ = ["curate", "exact_dedup", "near_dedup", "near_dedup_status", "preference_rows",
           "score", "outcome_rows", "summarise", "histogram", "box_stats", "rates_long"]
