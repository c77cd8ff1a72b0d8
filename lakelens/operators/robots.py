"""robots.txt as tables: statuses, blocks of agents, and whether the root may be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085  ]"
#: fixed values: the class of each known agent
AGENT_CLASS = {
    "gptbot": "training", "oai-searchbot": "retrieval", "chatgpt-user": "retrieval", "claudebot": "training", "claude-web": "retrieval", "claude-user": "retrieval",
    "claude-searchbot": "retrieval", "perplexitybot": "retrieval", "perplexity-user": "retrieval", "google-extended": "training", "googlebot": "hybrid", "bingbot": "hybrid",
    "applebot-extended": "training", "applebot": "hybrid", "ccbot": "training", "bytespider": "training", "amazonbot": "training", "meta-externalagent": "training",
    "meta-externalfetcher": "retrieval", "cohere-ai": "unknown", "diffbot": "unknown", "omgilibot": "unknown", "anthropic-ai": "unknown",
}


def status(raw: DataFrame) -> DataFrame:
    """site, robots_status, reason, body: what a fetch of robots.txt tells."""
    s = F.col("fetch_status")
    bad = s.isNull() | (s >= 500) | (s == 429) | ~s.isin(200, 404, 410)
    return raw.select(
        "site", F.when(bad, "unavailable").otherwise("ok").alias("robots_status"), F.when(bad, "robots_fetch_failed").alias("reason"),
        F.when(s == 200, F.coalesce("body", F.lit(""))).when(s.isin(404, 410), "").alias("body"),
    )


def agent_class(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in AGENT_CLASS.items() for x in kv])
    return F.when(F.trim(name) == "*", "generic").otherwise(F.coalesce(F.try_element_at(known, F.lower(F.trim(name))), F.lit("unknown")))


def matches_root(rule: Column) -> Column:
    """Whether a path rule matches '/': '*' is any run, a final '$' anchors, else a prefix."""
    anchored = rule.endswith("$")
    pattern = F.regexp_replace(rule, r"\$$", "")
    left = F.regexp_replace(pattern, r"\*", "")  # what must be there literally, in a path of one character
    starred = left.isin("", "/")
    return F.when(rule == "", True).when(pattern.contains("*"), starred).when(anchored, pattern == "/").otherwise(pattern.isin("", "/"))


def _lines(ok: DataFrame) -> DataFrame:
    """site, line, key, value of the lines that have a colon, without comments."""
    lines = ok.where("robots_status = 'ok'").select("site", F.posexplode(F.split("body", LINE_END)).alias("line", "text"))
    lines = lines.withColumn("line", F.col("line") + 1).withColumn("text", F.regexp_replace("text", "#.*", ""))
    return lines.where(F.col("text").contains(":")).select(
        "site", "line", F.lower(F.regexp_replace(F.split_part("text", F.lit(":"), F.lit(1)), r"(?U)^\s+|\s+$", "")).alias("key"),
        F.regexp_replace(F.regexp_extract("text", r"^[^:]*:(.*)$", 1), r"(?U)^\s+|\s+$", "").alias("value"),
    )


def rules(ok: DataFrame) -> DataFrame:
    """site, block, agent, line, allow, rule: rules of each agent's last block (null rule: none).

    A user-agent line opens a block if a rule came since the last one. An agent named in several
    blocks keeps its last one. Rules before the first user-agent line are dropped.
    """
    lines = _lines(ok)
    lines = lines.where(F.col("key").isin("user-agent", "disallow", "allow", "crawl-delay"))
    order = Window.partitionBy("site").orderBy("line")
    opens = (F.col("key") == "user-agent") & F.coalesce(F.lag("key").over(order) != "user-agent", F.lit(True))
    lines = lines.withColumn("block", F.sum(opens.cast("int")).over(order)).where("block > 0")
    agents = lines.where("key = 'user-agent'").groupBy("site", F.col("value").alias("agent")).agg(F.max("block").alias("block"))
    own = lines.where("key in ('allow', 'disallow')").select("site", "block", "line", (F.col("key") == "allow").alias("allow"), F.col("value").alias("rule"))
    own = own.where((F.col("rule") != "") | F.col("allow"))  # an empty Disallow is no rule
    return agents.join(own, ["site", "block"], "left")


def root_access(ok: DataFrame) -> DataFrame:
    """site, agent, class, allowed_root, matched_line, disallow_rules: the longest matching rule decides, ties allow.

    disallow_rules are those that match the root, shortest first."""
    r = rules(ok).withColumn("hit", F.coalesce(matches_root(F.col("rule")), F.lit(False)))
    rank = F.struct(F.length("rule").alias("n"), F.col("allow"), (-F.col("line")).alias("l"))
    against = F.array_sort(F.collect_set(F.when(F.col("hit") & ~F.col("allow"), F.struct(F.length("rule").alias("n"), F.col("line").alias("line"), F.col("rule").alias("rule")))))
    best = r.groupBy("site", "agent").agg(F.max(F.when(F.col("hit"), rank)).alias("best"), F.transform(against, lambda x: x["rule"]).alias("disallow_rules"))
    allowed = F.coalesce(F.col("best.allow"), F.lit(True))
    return best.select("site", "agent", agent_class(F.col("agent")).alias("class"), allowed.alias("allowed_root"), F.when(~allowed, -F.col("best.l")).alias("matched_line"), "disallow_rules")


def sitemaps(ok: DataFrame) -> DataFrame:
    """site, line, url: the Sitemap lines of robots.txt, in order; they belong to no agent."""
    found = _lines(ok).where("key = 'sitemap' and value <> ''")
    return found.select("site", "line", F.col("value").alias("url"))


def crawl_findings(statuses: DataFrame) -> DataFrame:
    """site, check_id, state, severity, strength, evidence of the two crawler checks (D-001, D-002), a row for each site and check."""
    access = root_access(statuses)
    named = F.col("agent") != "*"
    rule = F.when(F.get("disallow_rules", F.lit(0)).isNotNull(), F.concat(F.lit(" by "), F.get("disallow_rules", F.lit(0)))).otherwise("")
    said = F.struct(F.lower("agent").alias("k"), F.concat(F.lower("agent"), F.lit(" (line "), F.coalesce(F.col("matched_line").cast("string"), F.lit("?")), rule, F.lit(")")).alias("said"))
    blocked = lambda kinds: F.array_sort(F.collect_set(F.when(named & ~F.col("allowed_root") & F.col("class").isin(*kinds), said)))
    per = access.groupBy("site").agg(blocked(("retrieval", "hybrid")).alias("retrieval"), blocked(("training",)).alias("training"))
    all_sites = statuses.select("site", "robots_status").join(per, "site", "left")
    n = lambda name: F.greatest(F.lit(0), F.coalesce(F.size(name), F.lit(0)))
    listed = lambda name: F.array_join(F.transform(name, lambda x: x["said"]), ", ")
    r, t, ok = n("retrieval"), n("training"), F.col("robots_status") == "ok"
    first = F.when(~ok, "not_determinable").when(r > 0, "present").otherwise("absent")
    second = F.when(~ok, "not_determinable").when((r > 0) & (t > 0), "not_applicable").when(t > 0, "present").otherwise("absent")
    rows = F.array(
        F.struct(F.lit("CHK-D-001").alias("check_id"), first.alias("state"), F.lit("critical").alias("severity"), F.lit("HARD-MECHANICAL").alias("strength"), listed("retrieval").alias("evidence")),
        F.struct(F.lit("CHK-D-002").alias("check_id"), second.alias("state"), F.lit("low").alias("severity"), F.lit("CORRELATIONAL").alias("strength"), listed("training").alias("evidence")),
    )
    return all_sites.select("site", F.inline(rows))


def crawl_envelopes(statuses: DataFrame) -> DataFrame:
    """The crawler checks as envelopes, before all others of a report."""
    found = crawl_findings(statuses)
    present = F.col("state") == "present"
    return found.select(
        "site", F.when(F.col("check_id") == "CHK-D-001", -2).otherwise(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("url"), "check_id", "state", F.when(present, F.col("severity")).alias("severity"),
        "strength", F.lit(False).alias("recommendation"), F.lit("blocked").alias("defect_key"), F.lit(1).alias("violations"), F.when(present, F.col("evidence")).alias("evidence"),
    )
