"""Rules for prefixes of paths, joined to URLs by equality.

A rule holds for the paths that start with its prefix. Instead of comparing every URL with every rule of its host, a
host's rules say which lengths their prefixes have; a path gives one key for each of these lengths, and keys meet rules
in a hash join. So a URL costs the *different lengths* of its host's rules, at most the longest prefix, and a host with
many URLs is spread over tasks by its paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.functions.urls import part


def rules_of(lines: DataFrame, host: str, text: str, order: str, agent: str) -> DataFrame:
    """host, prefix and allow of the robots lines that concern an agent: those behind a user-agent line that is ``*`` or part of the agent's name
    (of several such lines in a row the last counts). Comments, blank prefixes and lines before any user-agent don't count."""
    bare = F.trim(F.split_part(F.coalesce(F.col(text), F.lit("")), F.lit("#"), F.lit(1)))
    value = F.trim(F.regexp_replace(bare, "^[^:]*:", ""))
    kind = F.lower(F.regexp_extract(bare, "(?i)^(user-agent|disallow|allow):", 1))
    known = lines.select(F.col(host).alias("host"), F.col(order).alias("_order"), kind.alias("kind"), value.alias("prefix")).where("kind <> ''")
    named = F.last(F.when(F.col("kind") == "user-agent", F.col("prefix")), ignorenulls=True).over(Window.partitionBy("host").orderBy("_order"))
    meant = (F.col("_agent") == "*") | ((F.col("_agent") != "") & F.lit(agent.lower()).contains(F.lower("_agent")))
    return known.withColumn("_agent", named).where(meant & (F.col("kind") != "user-agent") & (F.col("prefix") != "")).select("host", "prefix", (F.col("kind") == "allow").alias("allow")).distinct()


def path_of(url: Column) -> Column:
    path = part(url, "path")
    return F.when(path == "", F.lit("/")).otherwise(path)


def allowed(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """``urls`` with ``allowed``: false if a rule forbids the path and none allows it. URLs whose host has no rules, or that are null,
    are allowed. Rules (host, prefix, allow) may repeat; null and empty prefixes don't count; hosts compare as they are."""
    path = F.col("_path")
    placed = urls.withColumn("_host", part(F.col(url), "host")).withColumn("_path", path_of(F.col(url)))
    known = rules.where("prefix <> ''").groupBy("host", "prefix").agg(F.max("allow").alias("_allow"))
    lengths = known.groupBy(F.col("host").alias("_host")).agg(F.collect_set(F.length("prefix")).alias("_lengths"))  # at most the longest prefix
    each = placed.select("_host", "_path").distinct().join(lengths, "_host")
    keys = each.select("_host", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length(path))).alias("_n")).withColumn("_prefix", F.substring(path, F.lit(1), F.col("_n")))
    rule = known.select(F.col("host").alias("_host"), F.col("prefix").alias("_prefix"), "_allow")
    found = keys.join(rule, ["_host", "_prefix"]).groupBy("_host", "_path").agg(F.max("_allow").alias("_allow"))
    return placed.join(found, ["_host", "_path"], "left").select(*(F.col(f"`{c}`") for c in urls.columns), F.coalesce("_allow", F.lit(True)).alias("allowed"))
