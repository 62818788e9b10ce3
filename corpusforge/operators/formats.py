"""Trainer-facing row formats (P10, P11), as native column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import py_strip

# Fixed values (must equal the reference text).
INSTRUCTION_TEMPLATE = (
    "Below is an instruction that describes a task. Write a response that completes it."
    "\n\n### Instruction:\n", "\n\n### Response:\n")
SYSTEM_PROMPT = ("Return XML blocks strictly:\n"
                 "<reasoning>...</reasoning>\n<answer>...</answer>\n"
                 "Where <answer> contains ONLY a valid Python function definition.")


def instruction_rows(prefs: DataFrame, eos: str, response: str = "") -> DataFrame:
    """P10: prompt goes in the instruction slot (response slot empty); the
    end-of-sequence text is appended to chosen and rejected."""
    return prefs.select(
        F.concat(F.lit(INSTRUCTION_TEMPLATE[0]), F.col("prompt"),
                 F.lit(INSTRUCTION_TEMPLATE[1] + response)).alias("prompt"),
        F.concat(F.col("chosen"), F.lit(eos)).alias("chosen"),
        F.concat(F.col("rejected"), F.lit(eos)).alias("rejected"))


def chat_rows(tasks: DataFrame, system_prompt: str = SYSTEM_PROMPT,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Two chat messages (system, user=prompt) plus the stripped
    solution as ``reference``; other input columns are dropped unless named
    in ``keep``."""
    msg = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return tasks.select(*keep, msg.alias("prompt"),
                        py_strip(F.coalesce(F.col("canonical_solution"), F.lit(""))).alias("reference"))
