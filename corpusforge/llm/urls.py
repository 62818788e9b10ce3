"""URL filter (operator 2), DataFrame and Spark ML functions only.

A list of rules (host, path prefix, verdict) decides the urls it fits; the rest
is decided by association rules. The urls the list decides are the labelled
ones, and only they are mined: each becomes the set of its tokens with its
verdict, and Spark's FP-growth finds the rules "tokens => verdict" of enough
support and confidence among them. A confidence no higher than the verdict's
share of the labelled urls says nothing about the tokens, so such rules are not
kept (a list of one verdict gives none). The tokens that the list's own
rules consist of are left out, as they only repeat the list.

Both verdicts are classes. Of the rules that fire on a url the one of highest
confidence decides, then of highest support, then of fewest tokens, then allow.
A rule that contains a smaller one ranked before it never decides.

That is used before mining, so that long urls do not make item sets without
number; no rule that can decide is lost:
- a token of one verdict only has confidence 1, which no larger rule with it can
  pass, so it is a rule by itself and leaves the sets;
- tokens that stand in exactly the same labelled urls make the same rules, so
  they are mined as one item, which a url has if it has any of them;
- a token below the least support, or in every labelled url, adds nothing.
FP-growth combines what is left.

Matching: the urls to decide are reduced to their distinct token sets (a hot
set is pre-aggregated), the rules to an index from token to rule; a set fires
a rule if it meets all of the rule's tokens. Rules hold frequent tokens only
(each in at least ``min_support`` of the labelled urls), so the index is small;
its size is still checked before it is sent to every executor.
"""

from __future__ import annotations

import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import cut, join_checked, ready

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "verdict="


def host_of(url) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url, host, path) -> Column:
    """Distinct tokens: host labels, scheme, path words (digits as #), query keys."""
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    words = F.split(F.regexp_replace(F.translate(path, UPPER, LOWER), r"[0-9]+", "#"), r"[/._\-]+")
    keys = F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1))
    parts = F.concat(
        F.array(F.concat(F.lit("s:"), scheme)),
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("p:"), x)),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: F.length(x) > 2)))


def listed(host, path, rules) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null.
    A rule fits its host and its subdomains if the path starts with its path."""
    hits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    return F.array_max(F.array(*hits)) if hits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def list_tokens(rules) -> list[str]:
    """The tokens that the hosts and paths of the list consist of."""
    out = set()
    for host, path, _ in rules:
        words = re.sub(r"[0-9]+", "#", path.translate(str.maketrans(UPPER, LOWER)))
        out |= {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in re.split(r"[/._\-]+", words)}
    return sorted(out)


def mine(sets: DataFrame, min_support: float, min_confidence: float, least_urls: int) -> DataFrame:
    """``sets``: ``(_set, verdict)`` of the labelled urls. ``(rule, n, verdict,
    rank, item, token)``: the index of the rules that can decide. A url fires a
    rule if it has tokens of all of the rule's ``n`` items."""
    sets = cut(sets.withColumn("_row", F.monotonically_increasing_id()))
    total = sets.count()
    least = max(least_urls, -int(-(min_support * total) // 1))
    share = sets.groupBy("verdict").agg((F.count(F.lit(1)) / F.lit(total)).alias("share"))
    posts = sets.select("_row", "verdict", F.explode("_set").alias("token"))
    tokens = cut(posts.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "allow").alias("n_allow"),
        F.bit_xor(F.xxhash64("_row")).alias("mark")).where((F.col("n") >= least) & (F.col("n") < total)))
    mixed = tokens.where("n_allow > 0 and n_allow < n")
    # tokens of one mark and count are one item, once it is seen that they meet in all their urls
    item = mixed.groupBy("mark", "n").agg(F.min("token").alias("item"))
    items = mixed.join(item, ["mark", "n"]).select("token", "item", "n")
    held = cut(posts.join(items, "token").select("_row", "token", "item", "n"))
    apart = (held.alias("a").join(held.where("token = item").alias("b"),
                                  F.expr("a._row = b._row and a.item = b.item"), "left")
             .where("b._row is null").select("a.token").distinct().withColumn("apart", F.lit(True)))
    items = cut(items.join(apart, "token", "left")
                .select("token", F.when(F.col("apart"), F.col("token")).otherwise(F.col("item")).alias("item")))
    left = held.select("_row", "token").join(items, "token").groupBy("_row").agg(F.collect_set("item").alias("items"))
    baskets = (sets.join(left, "_row", "left").select(F.array_append(
        F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit(LABEL), "verdict")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=min_confidence).fit(baskets)
    verdict = F.element_at("consequent", 1)
    several = (model.associationRules.where(verdict.startswith(LABEL) & (F.col("lift") > 1))
               .where(~F.exists("antecedent", lambda x: x.startswith(LABEL)))
               .select(F.array_sort("antecedent").alias("items"),
                       F.substr(verdict, F.lit(len(LABEL) + 1)).alias("verdict"), "confidence", "support"))
    alone = (tokens.where("n_allow = 0 or n_allow = n")
             .select(F.array("token").alias("items"), F.when(F.col("n_allow") > 0, "allow").otherwise("block").alias("verdict"),
                     F.lit(1.0).alias("confidence"), (F.col("n") / F.lit(total)).alias("support"), F.col("token").alias("only")))
    alone = alone.join(share, "verdict").where("share < 1").drop("share")
    rules = cut(several.withColumn("only", F.lit(None).cast("string")).unionByName(alone)).select(
        F.xxhash64("items", "verdict").alias("rule"), "items", F.size("items").alias("n"), "verdict", "only",
        F.struct("confidence", "support", (-F.size("items")).alias("few"), (F.col("verdict") == "allow").alias("allow"))
        .alias("rank"))
    # a rule behind one of those with an item less never decides; larger gaps are left to the ranking
    less = rules.where("n > 1").select("rule", "rank", F.explode(F.transform(
        "items", lambda x: F.array_remove("items", x))).alias("part"))
    beaten = (less.alias("a").join(rules.alias("b"), F.expr("a.part = b.items and a.rank < b.rank"))
              .select("a.rule").distinct())
    rules = rules.join(beaten, "rule", "left_anti").select("rule", "n", "verdict", "rank", "only", F.explode("items").alias("item"))
    return (rules.where("only is null").drop("only").join(items, "item")
            .unionByName(rules.where("only is not null").select("rule", "n", "verdict", "rank", "item", F.col("only").alias("token"))))


def judge(df: DataFrame, id_col: str, url_col: str, rules, min_support: float = 0.01,
          min_confidence: float = 0.9, least_urls: int = 2) -> DataFrame:
    """One row per row of ``df``: ``(id_col, host, path, rule, verdict,
    mined)``; ``mined`` is true if an association rule gave another verdict than
    allow. Without a fitting rule of either kind the verdict is allow. A null url, or one
    without ``://``, has empty host and path and no tokens but its query's.
    A rule counts if it is seen on ``min_support`` of the labelled urls and on
    ``least_urls`` of them. Repeated rows count as often as they stand there. Urls
    of any length are judged whole. Other columns of ``df`` are not read, so their
    names cannot clash."""
    ready(df.sparkSession)
    url = F.col(url_col).cast("string")
    base = df.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                     url.alias("_url"))
    own = list_tokens(rules)
    tokens = F.filter(tokens_of(F.col("_url"), F.col("host"), F.col("path")), lambda x: ~x.isin(own))
    base = base.select("_id", "host", "path", tokens.alias("_set"),
                       listed(F.col("host"), F.col("path"), rules).alias("_hit"))
    seen = base.where("_hit is not null").select("_set", F.col("_hit.verdict").alias("verdict"))
    if seen.isEmpty():
        fired = base.select("_set", F.lit("").alias("_mined")).where(F.lit(False))
    else:
        index = cut(mine(seen, min_support, min_confidence, least_urls))
        size = index.agg(F.sum(2 * F.length("token") + 2 * F.length("item") + 128)).first()[0] or 0
        sets = base.where("_hit is null").select("_set").distinct()
        fired = (join_checked(sets.select("_set", F.explode("_set").alias("token")), index, "token", "inner", size)
                 .select("_set", "rule", "n", "verdict", "rank", "item").distinct()
                 .groupBy("_set", "rule", "n", "verdict", "rank").count().where("count = n")
                 .groupBy("_set").agg(F.max_by("verdict", "rank").alias("_mined")))
    fired = cut(fired)
    size = fired.agg(F.sum(F.length(F.concat_ws(",", "_set")) + 64)).first()[0] or 0
    out = join_checked(base, fired, "_set", "left", size)
    mined = F.when(F.col("_hit").isNull(), F.col("_mined"))
    return out.select(
        F.col("_id").alias(id_col), "host", "path", F.col("_hit.rule").alias("rule"),
        F.coalesce("_hit.verdict", mined, F.lit("allow")).alias("verdict"),
        F.coalesce(mined != "allow", F.lit(False)).alias("mined"))
