"""Explicit schemas for every dataset the library reads or writes."""

from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DoubleType,
                               IntegerType, LongType, StringType, StructField,
                               StructType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


REPOSITORY = _s(("full_name", StringType()), ("default_branch", StringType()))
SEARCH_ITEM = _s(("path", StringType()), ("repository", REPOSITORY))
SEARCH_PAGES = _s(("page", IntegerType()), ("status", IntegerType()),
                  ("items", ArrayType(SEARCH_ITEM)))

SOURCE_FILES = _s(("repo", StringType()), ("path", StringType()),
                  ("status", IntegerType()), ("content", BinaryType()))

FUNCTIONS = _s(("repo", StringType()), ("path", StringType()), ("fn_ord", IntegerType()),
               ("lineno", IntegerType()), ("name", StringType()), ("code", StringType()),
               ("docstring", StringType()), ("snippet_parses", BooleanType()),
               ("num_stmts", IntegerType()), ("num_calls", IntegerType()),
               ("num_branches", IntegerType()), ("status", StringType()))

TASKS = _s(("task_id", StringType()), ("prompt", StringType()),
           ("canonical_solution", StringType()), ("entry_point", StringType()),
           ("difficulty_scale", StringType()))

TASKS_VARIANT = _s(("task_id", StringType()), ("prompt", StringType()),
                   ("canonical_solution", StringType()), ("test", StringType()),
                   ("entry_point", StringType()), ("difficulty_scale", StringType()))

PREFERENCES = _s(("prompt", StringType()), ("chosen", StringType()),
                 ("rejected", StringType()))

MESSAGE = _s(("role", StringType()), ("content", StringType()))
CHAT = _s(("prompt", ArrayType(MESSAGE)), ("reference", StringType()))

COMPLETIONS = _s(("task_id", StringType()), ("generated_code", StringType()),
                 ("completion", StringType()), ("reference", StringType()),
                 ("canonical_solution", StringType()), ("completion_id", LongType()))

MEASUREMENTS = _s(("model", StringType()), ("task_id", StringType()),
                  ("has_circuit", BooleanType()), ("sv_ok", BooleanType()),
                  ("counts_ok", BooleanType()), ("ref_ok", BooleanType()),
                  ("fidelity", DoubleType()), ("depth", IntegerType()),
                  ("gates", IntegerType()))

OUTCOMES = _s(("model", StringType()), ("task_id", StringType()),
              ("compile_success", IntegerType()), ("sim_success", IntegerType()),
              ("fidelity", DoubleType()), ("depth", IntegerType()),
              ("completion_id", LongType()))

SUMMARY = _s(("model", StringType()), ("compile_rate", DoubleType()),
             ("sim_rate", DoubleType()), ("mean_fidelity", DoubleType()),
             ("median_depth", DoubleType()), ("count", LongType()))

RATES_LONG = _s(("model", StringType()), ("metric", StringType()), ("rate", DoubleType()))
