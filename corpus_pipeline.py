"""Corpus pipeline: five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows it is given.
All but the last return the columns of ``documents``; ``n_chars`` follows the
text. Null texts count as empty. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import bpe, mixing, quality, repeats, simhash
from corpusforge.llm.common import ready, table
from corpusforge.session import scratch_path


#: Bytes of a repeated string that the third stage cuts. Passages of over 50
#: words count; 51 words in a row take 152 bytes or more in all but one of a
#: thousand documents (measured on sf0.1).
PASSAGE_BYTES = 150


def quality_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return quality.filter_rows(docs, "text", model, threshold=0.3)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one row of each group stays, the one of smallest id (null
    ids last) and of those the first. Rows are numbered once and the numbers
    written, so rows that repeat an id, and rows without one, are told apart."""
    ready(spark)
    path = scratch_path(spark, "pipeline-numbered")
    number = "_row_no"          # a name that no column has
    while number in docs.columns:
        number += "_"
    docs.withColumn(number, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    own = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", F.col(number).alias("no"))
    groups = simhash.simhash_groups(rows.select(own.alias("_own"), "text"), "_own", "text", shingle=3, max_distance=3)
    stay = groups.where("_own.no = component_id.no").select(F.col("_own.no").alias(number))
    return rows.join(stay, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: bytes of strings of ``PASSAGE_BYTES`` that start elsewhere
    too are cut out of the text; characters cut through go as a whole."""
    return repeats.cut_rows(docs, "doc_id", "text", threshold=PASSAGE_BYTES)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every document is emitted as often as the mix takes it."""
    m = mixing.mix(docs, "doc_id", "source", "text", keep=docs.columns)
    return m.where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokenize(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids of every text."""
    import public_tokenizers
    keep = [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    ids = bpe.encode(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"),
                     public_tokenizers.PATTERN, keep=keep)
    return ids.select("doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_filter", quality_filter), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("mix_sources", mix_sources), ("tokenize", tokenize)]

#: The learned and hashed stages have no SQL form; tests/llm compares their operators with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
