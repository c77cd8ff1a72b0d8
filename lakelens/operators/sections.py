"""Sections of evidence: links, anchors, budgets, what is missing, and the whole bundle of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def links(results: DataFrame, most: int = 20) -> DataFrame:
    """The first results of each site, with the number of all of them as checked."""
    whole = Window.partitionBy("site")
    rows = results.withColumn("checked", F.count("*").over(whole)).withColumn("r", F.row_number().over(whole.orderBy("ord")))
    return rows.where(F.col("r") <= most).drop("r")


def anchors(results: DataFrame, most: int = 8, declared: DataFrame | None = None) -> DataFrame:
    """resolved (true, false or unknown) and note of the first anchors of each site.

    Sites that aren't in declared (site, url), if it is given, declare none, so they have no results.
    """
    if declared is not None:
        results = results.join(declared.select("site").distinct(), "site", "left_semi")
    s, get = F.col("http_status"), F.coalesce(F.upper("confirmed_by") == "GET", F.lit(False))
    unsure = s.isin(404, 405, 410, 501) & ~get
    resolved = F.when(unsure | s.isin(401, 403, 429) | s.isNull(), F.lit(None).cast("boolean")).otherwise(s.between(200, 399))
    note = F.when(unsure, "head_unsupported_unconfirmed").when(s.isin(401, 403, 429), "bot_blocked_not_broken").when(s.isNull(), "timeout")
    rows = results.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy("ord"))).where(F.col("r") <= most).drop("r")
    return rows.withColumn("resolved", resolved).withColumn("note", note)


def anchors_check(resolved: DataFrame) -> DataFrame:
    """site, state, severity: all determinable anchors failed (high), some (medium), or none could be told."""
    per = resolved.groupBy("site").agg(F.count("resolved").alias("n"), F.count_if(~F.col("resolved")).alias("bad"))
    state = F.when(F.col("n") == 0, "not_determinable").when(F.col("bad") > 0, "present").otherwise("absent")
    return per.select("site", state.alias("state"), F.when(F.col("bad") == 0, None).when(F.col("bad") == F.col("n"), "high").otherwise("medium").alias("severity"))


#: Stages of a collection.
STAGES = "site string, name string, budget_s double, actual_s double, abandoned boolean, planned_items int, completed_items int, reason string"


def status(sites: DataFrame, results: DataFrame, reason: str) -> DataFrame:
    """site, status, reason of a section: ok where there are results, else unavailable for that reason."""
    some = results.select("site", F.lit(True).alias("some")).distinct()
    ok = F.coalesce("some", F.lit(False))
    return sites.select("site").distinct().join(some, "site", "left").select("site", F.when(ok, "ok").otherwise("unavailable").alias("status"), F.when(~ok, reason).alias("reason"))


def reachable(rows: DataFrame, robots: DataFrame) -> DataFrame:
    """rows of sites whose robots.txt could be had, or that have none in the table; of others nothing is to be fetched."""
    return rows.join(robots.where("robots_status <> 'ok'").select("site").distinct(), "site", "left_anti")


def discovery(inventory: DataFrame) -> DataFrame:
    """site, urls, sitemap_found: the size of each site's inventory, and whether a sitemap gave any of it."""
    return inventory.groupBy("site").agg(F.count("*").alias("urls"), F.bool_or(F.coalesce(F.col("source"), F.lit("")) == "sitemap").alias("sitemap_found"))


def bundle(sites: DataFrame, most: int = 200, **tables: DataFrame) -> DataFrame:
    """One nested row for each site, for export: of each table with columns site and ord, its first rows in order."""
    out = sites.select(F.struct(*sites.columns).alias("about"), "site").withColumn("schema_version", F.lit("1.0.0"))
    for name, df in tables.items():
        first = df.withColumn("__r", F.row_number().over(Window.partitionBy("site").orderBy("ord"))).where(F.col("__r") <= most).drop("__r")
        rest = [c for c in df.columns if c not in ("site", "ord")]
        out = out.join(first.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", *rest))).alias(name)), "site", "left")
    return out


def budget(stages: DataFrame, cap: float = 300.0) -> DataFrame:
    return stages.groupBy("site").agg(F.bround(F.sum(F.coalesce("actual_s", F.lit(0.0))), 1).alias("total_s"), F.lit(cap).alias("cap_s"), F.array_sort(F.collect_list(F.when(F.col("abandoned"), F.col("name")))).alias("abandoned"))
