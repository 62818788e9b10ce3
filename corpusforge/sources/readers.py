"""Sources (S1-S4, S6, S8, S9, S11)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusforge.functions.text import normalize_newlines
from corpusforge.session import bucketed_table, join_group_stats, written
from corpusforge.sources import schemas
from corpusforge.sources.writers import CSV_OPTIONS, unmark_nulls

# Fixed values.
RAW_BASE = "https://raw.githubusercontent.com"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- S1-S3: candidate listing -------------------------------------------------

def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved search-result pages, one JSON object per page:
    ``{page, status, items: [{path, repository: {full_name, default_branch}}]}``."""
    return spark.read.schema(schemas.SEARCH_PAGES).json(path)


def listing(pages: DataFrame, max_files: int | None = None, per_page: int = 100) -> DataFrame:
    """Items of the pages in page order, stopping at the first missing,
    failed (status other than 200) or empty page and after the first page
    shorter than ``per_page``; all items, or the first ``max_files`` if given
    (a top-k by (page, position))."""
    p = pages.select("page", F.coalesce("status", F.lit(200)).alias("status"), "items")
    ok = (F.col("status") == 200) & (F.coalesce(F.size("items"), F.lit(0)) > 0)
    nxt = p.select((F.col("page") + 1).alias("page"))
    missing = nxt.join(p.select("page"), "page", "left_anti")
    bounds = p.agg(
        F.min(F.when(~ok, F.col("page"))).alias("first_bad"),
        F.min(F.when(ok & (F.size("items") < per_page), F.col("page"))).alias("first_short"),
        F.max(F.when(F.col("page") == 1, F.lit(1))).alias("has_first")).first()
    first_missing = missing.agg(F.min("page")).first()[0]
    if not bounds["has_first"]:
        return pages.sparkSession.createDataFrame([], _LISTING_SCHEMA)
    last = min(x for x in (
        (bounds["first_bad"] - 1) if bounds["first_bad"] is not None else None,
        (first_missing - 1) if first_missing is not None else None,
        bounds["first_short"]) if x is not None)
    items = (p.where(F.col("page") <= last)
             .select("page", F.posexplode("items").alias("pos", "item")))
    if max_files is not None:
        items = items.orderBy("page", "pos").limit(max_files)
    return (items
            .select("page", "pos", F.col("item.path").alias("path"),
                    F.col("item.repository.full_name").alias("repo"),
                    F.col("item.repository.default_branch").alias("branch")))


_LISTING_SCHEMA = "page int, pos int, path string, repo string, branch string"


def raw_url(repo="repo", branch="branch", path="path", base: str = RAW_BASE) -> Column:
    """``{base}/{repo}/{branch}/{path}``."""
    return F.concat_ws("/", F.lit(base), _c(repo), _c(branch), _c(path))


def flat_name(repo="repo", path="path") -> Column:
    """S3: ``/`` -> ``_`` in repo and path, joined by ``__``, ``.py`` added
    unless present. Not unique (``a_b/c`` vs ``a/b_c``): keep it as a
    column, key rows by (repo, path)."""
    base = F.concat(F.translate(_c(repo), "/", "_"), F.lit("__"), F.translate(_c(path), "/", "_"))
    return F.when(base.endswith(".py"), base).otherwise(F.concat(base, F.lit(".py")))


# ---- S4: source files -----------------------------------------------------------

def decode_source(df: DataFrame, content_col: str = "content") -> DataFrame:
    """S4 text read: undecodable (invalid UTF-8) files are skipped whole;
    ``\\r\\n`` and ``\\r`` become ``\\n``."""
    s = F.col(content_col).cast("string")
    return (df.where(F.is_valid_utf8(s))
              .withColumn(content_col, normalize_newlines(s)))


def read_source_files(spark: SparkSession, root: str, glob: str = "*.py",
                      repo_depth: int = 2) -> DataFrame:
    """Whole files under ``root`` as rows ``(repo, path, status, content)``;
    ``repo`` is the first ``repo_depth`` folders below ``root``. Binary
    read, then UTF-8 validated and newline-normalised (S4)."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).load(root))
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(prefix.split("://")[-1]), "")
    parts = F.split(rel, "/")
    repo = F.array_join(F.slice(parts, 1, repo_depth), "/")
    path = F.array_join(F.slice(parts, repo_depth + 1, 1 << 20), "/")
    files = raw.select(repo.alias("repo"), path.alias("path"),
                       F.lit(200).alias("status"), F.col("content"))
    return decode_source(files)


# ---- S6, S8, S9, S11: dataset readers ------------------------------------------

def read_tasks_json(spark: SparkSession, path: str, variant: bool = False,
                    multiline: bool = False) -> DataFrame:
    """JSON Lines (our writer) or, with ``multiline``, one pretty-printed
    JSON array (the reference format; one task per file). Text of another
    form, such as an array read without ``multiline``, is an error."""
    schema = schemas.TASKS_VARIANT if variant else schemas.TASKS
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def read_preferences_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header and multi-line quoted fields; exact round trip
    with :func:`corpusforge.sources.writers.write_preferences_csv`."""
    return unmark_nulls(spark.read.schema(schemas.PREFERENCES).options(**CSV_OPTIONS)
                        .option("multiLine", True).option("emptyValue", "").csv(path))


def read_completions(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Completion records. JSON Lines (splittable) by default; with
    ``multiline`` one JSON array per file (the reference format, one task
    per file). Entries that are not JSON objects land in ``_corrupt_record``
    one by one, and the whole text of a file that is no array does (E2
    quarantines them, the rest goes on)."""
    if not multiline:
        schema = StructType(schemas.COMPLETIONS.fields + [StructField("_corrupt_record", StringType())])
        return (spark.read.schema(schema).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    raw = spark.read.text(path, wholetext=True)
    elems = raw.select(F.explode(F.coalesce(F.from_json("value", ArrayType(StringType())),
                                            F.array("value"))).alias("_raw"))
    record = StructType(schemas.COMPLETIONS.fields + [StructField("_corrupt_record", StringType())])
    is_obj = F.ltrim(F.col("_raw")).startswith("{")
    parsed = elems.select("_raw", F.when(is_obj, F.from_json(
        "_raw", record, {"columnNameOfCorruptRecord": "_corrupt_record"})).alias("_r"))
    is_obj = is_obj & F.col("_r._corrupt_record").isNull()
    return parsed.select(*[F.col("_r")[f.name].alias(f.name) for f in schemas.COMPLETIONS.fields],
                         F.when(~is_obj | F.col("_r").isNull(), F.col("_raw")).alias("_corrupt_record"))


def read_array_elements(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """S6/S9 for arrays of objects larger than a task: rows ``(array_file,
    pos, element, bad)``, ``element`` the JSON text of one array element and
    ``pos`` the object it stands at or before. With ``parts`` the files of a
    folder are the consecutive pieces of one array (see
    :func:`corpusforge.sources.writers.write_array`).

    Files are cut at every ``}`` by the text source, so one file is read by
    many tasks. What a piece does to the string state (unescaped quotes) and to
    the depth of nesting is counted for both states it may start in; sums over
    the splits of a file, one row a split, then say which one holds and where
    the elements end. Text that is not JSON lands in ``bad`` and the elements
    around it go on; so does what follows the last whole element of a file cut
    short, piecewise by split. A file that ends in an open string is bad from
    there on, a file whose top level is no array altogether. Empty arrays and
    empty files give no rows."""
    made: list[str] = []
    t = F.col("t")
    bare = F.regexp_replace(t, r"(?s)\\.", "")                # escapes only occur inside strings
    meta = F.col("_metadata")
    pieces = (spark.read.option("lineSep", "}").text(path)
              .select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"),
                      meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("seq"),
                      F.col("value").alias("t"))
              .withColumn("array_file", F.regexp_replace("file", "/[^/]*$", "") if parts else F.col("file"))
              .withColumn("unit", F.concat_ws(":", "file", "start")))

    def depth(text, closed):
        """Change of depth over a piece and the ``}`` behind it."""
        plain = F.regexp_replace(text, r'(?s)"[^"]*("|$)', "")
        ups = F.length(plain) - F.length(F.translate(plain, "{[", ""))
        downs = F.length(plain) - F.length(F.translate(plain, "]", ""))
        return (ups - downs - F.when(closed, 1).otherwise(0)).cast("long")

    odd = F.col("quotes") % 2 == 1
    pieces = (pieces.withColumn("quotes", F.regexp_count(bare, F.lit('"')))
              .withColumn("from_out", depth(bare, ~odd))
              .withColumn("from_in", depth(F.concat(F.lit('"'), bare), odd)))
    nparts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = bucketed_table(pieces, "unit", nparts, "array-pieces", made)

    # per split: string state and depth as if it began outside, and inside, a string
    order = Window.partitionBy("unit").orderBy("seq")
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = (table.withColumn("p", before)
            .withColumn("d_out", F.sum(F.when(F.col("p") == 0, F.col("from_out")).otherwise(F.col("from_in"))).over(to_here))
            .withColumn("d_in", F.sum(F.when(F.col("p") == 0, F.col("from_in")).otherwise(F.col("from_out"))).over(to_here)))
    units = (runs.groupBy("unit", "array_file", "file", "start", "size")
             .agg(F.sum("quotes").alias("quotes"), F.max_by("d_out", "seq").alias("t_out"),
                  F.max_by("d_in", "seq").alias("t_in"), F.max("seq").alias("last_seq"),
                  (F.sum(F.octet_length("t")) + F.count(F.lit(1))).alias("nbytes")))
    splits = Window.partitionBy("array_file").orderBy("file", "start")
    prior = splits.rowsBetween(Window.unboundedPreceding, -1)
    units = (units.withColumn("inside", F.coalesce(F.sum("quotes").over(prior), F.lit(0)) % 2 == 1)
             .withColumn("total", F.when(F.col("inside"), F.col("t_in")).otherwise(F.col("t_out")))
             # the last piece of a file has no } behind it unless the bytes add up
             .withColumn("open_end", F.sum("nbytes").over(Window.partitionBy("file")) > F.col("size"))
             .withColumn("final", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("start"))) == 1))
    # such a missing } was counted where the file did not end inside a string
    ends_in = F.coalesce(F.sum("quotes").over(splits), F.lit(0)) % 2 == 1
    lost = F.col("open_end") & F.col("final")
    units = units.withColumn("total", F.col("total") + F.when(lost & ~ends_in, 1).otherwise(0))
    units = written(units.withColumn("base", F.coalesce(F.sum("total").over(prior), F.lit(0)))
                    .select("unit", "inside", "base", "last_seq", lost.alias("lost")), "array-splits")

    runs = join_group_stats(runs, units, "unit")
    level = F.col("base") + F.when(F.col("inside"), F.col("d_in")).otherwise(F.col("d_out"))
    after = F.col("p") + F.col("quotes") + F.when(F.col("inside"), 1).otherwise(0)
    runs = (runs.withColumn("closed", ~(F.col("lost") & (F.col("seq") == F.col("last_seq"))))
            .withColumn("ends", F.col("closed") & (after % 2 == 0) & (level == 1))
            .withColumn("k", F.coalesce(F.sum(F.col("ends").cast("long")).over(
                order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .select("array_file", "file", "start", "unit", "seq", "k", "ends",
                    F.concat("t", F.when(F.col("closed"), F.lit("}")).otherwise(F.lit(""))).alias("t")))
    runs = written(runs, "array-runs")
    count = runs.groupBy("unit", "array_file", "file", "start").agg(F.sum(F.col("ends").cast("long")).alias("n"))
    count = written(count.select(
        "unit", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("n0"),
        F.sum("n").over(Window.partitionBy("array_file")).alias("n_all")), "array-counts")
    runs = join_group_stats(runs, count, "unit").withColumn("pos", F.col("n0") + F.col("k"))
    tail = F.col("pos") == F.col("n_all")       # behind the last whole element: by split
    body = (runs.groupBy("array_file", "pos", tail.alias("tail"), F.when(tail, F.col("unit")).alias("u"))
            .agg(F.sort_array(F.collect_list(F.struct("file", "start", "seq", "t"))).alias("l"))
            .select("array_file", "pos", "tail", F.array_join(F.transform("l", lambda x: x["t"]), "").alias("raw")))
    text = F.regexp_replace("raw", r"^\s*" + r"[\[,]", "")
    shut = F.col("raw").rlike(r"\]\s*$")
    text = F.when(F.col("tail") & shut, F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    opens = F.col("raw").rlike(r"^\s*\[")
    begins = F.when(F.col("pos") == 0, opens).otherwise(F.col("raw").rlike(r"^\s*,") | (F.col("tail") & F.col("raw").rlike(r"^\s*\]")))
    ok = begins & (shut | ~F.col("tail"))
    text = F.when(F.col("raw").rlike(r"^\s*\]\s*$") & (F.col("pos") > 0), F.lit("")).otherwise(text)
    body = (body.select("array_file", "pos", "raw", ok.alias("ok"), F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("x"))
            .where(~((F.col("x") == "") & F.col("ok")) & ~F.col("raw").rlike(r"^\s*$"))
            .withColumn("all", F.when(F.col("ok"), F.from_json(
                F.concat(F.lit("["), "x", F.lit("]")), ArrayType(StringType())))))
    out = written(body.select("array_file", "pos", F.explode_outer("all").alias("element"),
                              F.when(F.col("all").isNull(), F.col("raw")).alias("bad")), "array-elements")
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """The per-model summary table."""
    return spark.read.schema(schemas.SUMMARY).option("header", True).csv(path)


def read_outcomes_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """The per-completion detail table; ``None`` when it is absent
    (that output is then skipped, as in the reference)."""
    if not path_exists(spark, path):
        return None
    return unmark_nulls(spark.read.schema(schemas.OUTCOMES).options(**CSV_OPTIONS)
                        .option("multiLine", True).option("emptyValue", "").csv(path))
