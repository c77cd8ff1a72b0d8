"""From envelopes to reports: roll-ups, ids, summaries, passed checks, priorities, self-checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .checks import first_three

# --- fixed values -------------------------------------------------------------------------------
SEVERITIES = ("critical", "high", "medium", "low")
PRIORITY_CLASS = {
    **{f"CHK-D-{n:03d}": 1 for n in (1, 2, 3)},
    **{f"CHK-D-{n:03d}": 2 for n in (6, 7, 8, 12, 25, 26, 27, 29, 30, 31, 32, 33, 34)},
    **{f"CHK-D-{n:03d}": 3 for n in (4, 5, 9, 10, 11, 13)},
    **{f"CHK-E-{n:03d}": 3 for n in (14, 15, 16, 17, 18, 19, 20, 21, 22, 24)},
}
STRENGTH_RANK = {"HARD-MECHANICAL": 1, "HARD-MECHANICAL/CAUSAL": 1, "NORMATIVE": 2, "NORMATIVE/PRACTITIONER": 2, "CORRELATIONAL": 3, "THEORETICAL/CORRELATIONAL": 3, "THEORETICAL/HEURISTIC": 4, "THEORETICAL": 4}
PRESCRIPTIVE = ("Add ", "Repair ", "Replace ", "Give every ", "Implement ", "Wrap ", "Insert ")
MARKUP = ("<h1>", "<meta name=", 'rel="canonical"', "301 redirect", "aria-label")
PROHIBITED = (
    r"(?i)\bllms?\.txt\b", r"(?i)\bwill (?:be cited|get cited|appear in|rank)\b", r"(?i)\bguarantee[sd]?\b.{0,40}\b(?:citation|visibility|ranking)", r"(?i)\bhidden text\b|\bwhite text on white\b",
    r"(?i)\bgenerate\b.{0,30}\bbulk\b|\bbulk\b.{0,30}\bcontent\b", r"(?i)\babove the fold\b", r"(?i)\breading[- ]grade\b|\bflesch\b", r"(?i)\blighthouse\b.{0,20}\b100\b|\bscore of 100\b",
    r"(?i)\bremove all (?:popups?|modals?)\b", r"(?i)\baccessible sites convert better\b", r"(?i)\b1 ?s(?:econd)? delay\b.{0,30}\b7%|\b100 ?ms\b.{0,30}\b1%",
    r"(?i)\b3[- ]second\b.{0,20}\bbounce\b", r"(?i)\b9\.2 ?mm\b",
)
CONTRADICTED = {"identity_jsonld": ("CHK-D-006", "CHK-D-007"), "canonical_consistency": ("CHK-D-008",), "retrieval_crawler_access": ("CHK-D-001",)}
CAPPED = ("CHK-E-014", "CHK-E-022")
TITLES = {
    "CHK-D-001": "Retrieval-time AI crawler blocked at root", "CHK-D-002": "Training-corpus crawler blocked, retrieval intact",
    "CHK-D-003": "Primary content and h1 missing from raw HTML (JS-render gap)", "CHK-D-004": "Thin main content", "CHK-D-005": "Missing or generic subheadings",
    "CHK-D-006": "No explicit organisation-definition sentence", "CHK-D-007": "Missing or incomplete Organization JSON-LD", "CHK-D-008": "Missing or cross-domain canonical tag",
    "CHK-D-009": "Broken internal links", "CHK-D-010": "Low extractable-evidence density", "CHK-D-011": "Pronoun-saturated key claims",
    "CHK-D-012": "Missing date on time-sensitive content", "CHK-D-013": "Near-duplicate templated content", "CHK-D-025": "No declared identity anchors",
    "CHK-D-026": "Declared identity anchors do not resolve", "CHK-D-027": "Inconsistent organisation identity attributes", "CHK-D-029": "Product and offer data for ecommerce pages",
    "CHK-D-030": "Software and pricing data for SaaS pages", "CHK-D-031": "Listing data for marketplace pages", "CHK-D-032": "Article provenance and feed discovery for news sites",
    "CHK-D-033": "Author identity and feed discovery for personal sites", "CHK-D-034": "Repository or dataset data for code and data archives",
    "CHK-E-014": "Machine-detectable accessibility violations", "CHK-E-015": "Mobile viewport meta missing or restricting user zoom", "CHK-E-016": "Tap targets below WCAG 2.2 minimum size",
    "CHK-E-017": "Non-descriptive link text", "CHK-E-018": "Content-blocking overlay present at load", "CHK-E-019": "Blank first paint with no fallback",
    "CHK-E-020": "Autoplaying media with sound", "CHK-E-021": "Images/iframes missing dimensions (layout-shift cause)", "CHK-E-022": "Missing landmark or heading structure",
    "CHK-E-024": "Missing trust signals",
}
PROTECTED = r"(?i)primary[_ -]?nav|navigation|skip[_ -]?link"
CONSUMERS = {
    "robots_discovery": ("CHK-D-001", "CHK-D-002"), "static_fetch": tuple(c for c in TITLES if c not in ("CHK-D-001", "CHK-D-002", "CHK-D-026")),
    "render_pass": ("CHK-D-003", "CHK-E-014", "CHK-E-015", "CHK-E-016", "CHK-E-018", "CHK-E-019"), "internal_links": ("CHK-D-009",), "offsite_anchors": ("CHK-D-026",),
}
DOM_DEPENDENT = ("CHK-E-014", "CHK-E-015", "CHK-E-022", "CHK-D-003", "CHK-D-009", "CHK-E-018", "CHK-E-019", "CHK-E-021")
LIMITATIONS = ("LIM-01", "LIM-02", "LIM-03", "LIM-04", "LIM-05")
# ------------------------------------------------------------------------------------------------
#: Reasons of the declared limitations, and what a kind of site changes in an audit, in this library's words.
REASONS = {
    "LIM-01": "What other sites say about the brand isn't known from the site alone.", "LIM-02": "Whether another entity has the same name isn't known from the site alone.",
    "LIM-03": "No assistant was asked whether it cites the site.", "LIM-04": "How visitors behave isn't known without analytics.", "LIM-05": "A file of hints for language models isn't advised, as crawlers hardly ask for one.",
}
EFFECTS = {
    "personal": "Checks of organisations are left out; the person, feeds and bylines are checked instead.", "ecommerce": "Trust signals and product data are checked.",
    "documentation": "Versions of a page don't count as duplicates.", "news_editorial": "Dates, provenance of articles, feeds and trust signals are checked.",
    "saas_marketing": "Trust signals and data on software and prices are checked.", "local_business": "Trust signals are checked.", "marketplace": "Data on listings are checked.",
    "reference": "Archives of code or data are checked for their data.", "institutional": "Archives of code or data are checked for their data.",
    "brochure": "Checks that need more pages are left out.", "unknown": "No kind of site could be told, so no check depends on it.",
}
STATIC_NOTE = "Judged from static HTML: what needs a rendering is not determinable, not clean."
BLOCKED_NOTE = "Findings on content are about pages that the blocked agents can't reach."


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def severity_rank(s: Column) -> Column:
    return _lookup({x: i for i, x in enumerate(SEVERITIES)}, s, 4)


def masked(evidence: Column) -> Column:
    """Evidence without what differs from page to page: addresses and numbers."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(evidence, F.lit("")), r"https?://\S+", "<url>"), r"\d+", "<n>")


def _defects(envelopes: DataFrame) -> DataFrame:
    """Present rows that aren't recommendations, with their signature."""
    signature = F.when(F.col("check_id") == "CHK-E-014", F.lit("")).otherwise(masked(F.col("evidence")))
    return envelopes.where("state = 'present' and not recommendation").withColumn("signature", signature)


def roll_up(envelopes: DataFrame) -> DataFrame:
    """site, check_id, defect_key, severity, strength, url, evidence, examples, occurrences, first_seq, site_wide.

    Defects (present, no recommendation) of one kind and signature on two or more pages become one
    site-wide row, with the worst severity, the first on ties. Accessibility severities come from
    the number of violations (at most two: low, but medium where navigation or skip links fail; else
    medium) and never exceed medium. examples are the first three addresses; instances() has all.
    """
    bad = _defects(envelopes)
    keys = ["site", "check_id", "defect_key", "signature"]
    best = F.min_by(F.struct("severity", "strength", "url", "evidence"), F.struct(severity_rank(F.col("severity")), F.col("seq")))
    g = bad.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("n"), F.sum("violations").alias("v"), F.min("seq").alias("first_seq"), F.min_by("url", "seq").alias("first_url"))
    g = g.join(first_three(bad.select(*keys, "seq", "url"), keys, ["seq", "url"], F.col("url")), keys, "left")
    wide = F.col("n") >= 2
    floor = F.when(F.col("defect_key").rlike(PROTECTED), "medium").otherwise("low")
    rolled = F.when((F.col("check_id") == "CHK-E-014") & wide, F.when(F.col("v") <= 2, floor).otherwise("medium")).otherwise(F.col("b.severity"))
    capped = F.when(F.col("check_id").isin(*CAPPED) & rolled.isin("critical", "high"), "medium").otherwise(rolled)
    said = F.when(wide, F.concat(F.lit("Site-wide, on "), F.col("n").cast("string"), F.lit(" pages. First: "), F.coalesce(F.col("b.evidence"), F.lit("")))).otherwise(F.col("b.evidence"))
    return g.select(
        "site", "check_id", "defect_key", capped.alias("severity"), F.col("b.strength").alias("strength"), F.when(wide, F.col("first_url")).otherwise(F.col("b.url")).alias("url"),
        said.alias("evidence"), "examples", F.col("n").alias("occurrences"), "first_seq", wide.alias("site_wide"),
    )


def instances(envelopes: DataFrame) -> DataFrame:
    """site, check_id, defect_key, seq, url, severity, evidence: every single defect that a site-wide row stands for."""
    bad = _defects(envelopes)
    keys = ["site", "check_id", "defect_key", "signature"]
    wide = bad.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 2").select(*keys)
    severity = F.when((F.col("check_id") == "CHK-E-014") & (F.col("violations") <= 2), "low").when(F.col("check_id").isin(*CAPPED) & F.col("severity").isin("critical", "high"), "medium").otherwise(F.col("severity"))
    return bad.join(wide, keys, "left_semi").select("site", "check_id", "defect_key", "seq", "url", severity.alias("severity"), "evidence")


def findings(rolled: DataFrame) -> DataFrame:
    """Rolled-up rows with titles and ids F-001, ... by severity, check and first appearance."""
    rolled = rolled.withColumn("title", _lookup(TITLES, F.col("check_id"), ""))
    order = Window.partitionBy("site").orderBy(severity_rank(F.col("severity")), "check_id", "first_seq", "defect_key", "evidence")
    return rolled.withColumn("finding_id", F.format_string("F-%03d", F.row_number().over(order)))


def recommendations(envelopes: DataFrame) -> DataFrame:
    """Recommendations of one kind as one row, the first standing for all; ids in order of arrival."""
    some = envelopes.where("state = 'present' and recommendation")
    g = some.groupBy("site", "check_id", "defect_key").agg(F.min_by(F.struct("severity", "strength", "url", "evidence"), "seq").alias("b"), F.count("*").alias("occurrences"), F.min("seq").alias("first_seq"))
    ids = F.format_string("R-%03d", F.row_number().over(Window.partitionBy("site").orderBy("first_seq", "check_id", "defect_key")))
    title = _lookup(TITLES, F.col("check_id"), "")
    summary = F.concat(F.lit("Consider what this means for readers and crawlers: "), F.lower(title), F.lit("."))
    return g.select("site", ids.alias("rec_id"), "check_id", title.alias("title"), "defect_key", "b.severity", "b.strength", "b.url", "b.evidence", summary.alias("summary"), "occurrences", "first_seq")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("site").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def degraded_stages(stages: DataFrame) -> DataFrame:
    """site, stage, planned_items, completed_items, affected_checks: stages of a collection that were given up."""
    affected = F.create_map(*[x for k, v in CONSUMERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return stages.where("abandoned").select("site", F.col("name").alias("stage"), "planned_items", "completed_items", F.coalesce(F.try_element_at(affected, F.col("name")), F.array().cast("array<string>")).alias("affected_checks"))


def starved_checks(degraded: DataFrame, access: DataFrame) -> DataFrame:
    """(site, check_id): checks whose input was given up, and those on markup where no page could be read and robots neither."""
    lost = degraded.select("site", F.explode("affected_checks").alias("check_id"))
    return lost.unionByName(access.where("access = 'full_block'").select("site", F.explode(F.array(*map(F.lit, DOM_DEPENDENT))).alias("check_id"))).distinct()


def checks_passed(envelopes: DataFrame, starved: DataFrame | None = None) -> DataFrame:
    """Checks of a site with an absent row and no defect, unless a recommendation advises on them or their input is missing."""
    per = envelopes.groupBy("site", "check_id").agg(F.bool_or((F.col("state") == "present") & ~F.col("recommendation")).alias("bad"), F.bool_or(F.col("state") == "absent").alias("good"))
    advised = envelopes.where("state = 'present' and recommendation").select("site", "check_id").distinct()
    known = per.where(F.col("good") & ~F.col("bad") & F.col("check_id").isin(*TITLES)).select("site", "check_id").join(advised, ["site", "check_id"], "left_anti")
    return known if starved is None else known.join(starved, ["site", "check_id"], "left_anti")


def top_priorities(found: DataFrame, recs: DataFrame, most: int = 3) -> DataFrame:
    """The first items of each site by class, strength, severity, occurrences, check and id."""
    columns = ("site", "id", "check_id", "severity", "strength", "occurrences", "half")
    items = found.select("site", F.col("finding_id").alias("id"), "check_id", "severity", "strength", "occurrences", F.lit(0.0).alias("half")).unionByName(
        recs.select("site", F.col("rec_id").alias("id"), "check_id", "severity", "strength", "occurrences", F.lit(0.5).alias("half"))
    )
    items = items.select(*columns).withColumn("klass", F.least(F.lit(4.0), _lookup(PRIORITY_CLASS, F.col("check_id"), 4).cast("double") + F.col("half"))).where("klass <= 2.5")
    order = Window.partitionBy("site").orderBy("klass", _lookup(STRENGTH_RANK, F.col("strength"), 5), severity_rank(F.col("severity")), F.desc("occurrences"), "check_id", "id")
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("site", "place", "id", "check_id", "klass")


def access_state(pages: DataFrame, degraded: DataFrame | None = None) -> DataFrame:
    """site, pages_fetched, access: ok if any page could be read; else full_block where robots were given up, too, or partial_block."""
    per = pages.groupBy("site").agg(F.count_if("extraction_ok").alias("pages_fetched"))
    lost = F.lit(False)
    if degraded is not None:
        per = per.join(degraded.where("stage = 'robots_discovery'").select("site", F.lit(True).alias("lost")).distinct(), "site", "left")
        lost = F.coalesce("lost", F.lit(False))
    return per.select("site", "pages_fetched", F.when(F.col("pages_fetched") > 0, "ok").when(lost, "full_block").otherwise("partial_block").alias("access"))


def limitations(access: DataFrame, found: DataFrame) -> DataFrame:
    """site, id, lim_id, reason, affected_checks: the declared limitations of every report, and one more where no page could be read."""
    none = F.array().cast("array<string>")
    declared = access.select("site", F.posexplode(F.array(*[F.struct(F.lit(k).alias("lim_id"), F.lit(REASONS[k]).alias("reason")) for k in LIMITATIONS])).alias("k", "l"))
    declared = declared.select("site", "k", "l.lim_id", "l.reason", none.alias("affected_checks"))
    checks = found.groupBy("site").agg(F.array_sort(F.collect_set("check_id")).alias("affected"))  # at most one for each check
    more = access.where("access <> 'ok'").join(checks, "site", "left")
    more = more.select("site", F.lit(len(LIMITATIONS)).alias("k"), F.lit("BUDGET-degraded_stages").alias("lim_id"), F.lit("No sampled page could be read, so all else here is advice only.").alias("reason"), F.coalesce("affected", none).alias("affected_checks"))
    return declared.unionByName(more).select("site", F.format_string("L-%03d", F.col("k") + 1).alias("id"), "lim_id", "reason", "affected_checks")


def preambles(access: DataFrame, sites: DataFrame, envelopes: DataFrame) -> DataFrame:
    """site, access, archetype, notes: how a report is to be read. A site without any read page has no known kind."""
    blocked = envelopes.where("check_id = 'CHK-D-001' and state = 'present'").select("site", F.lit(True).alias("blocked")).distinct()
    df = access.join(sites.select("site", F.col("archetype").alias("kind")), "site", "left").join(blocked, "site", "left")
    kind = F.when(F.col("pages_fetched") == 0, "unknown").otherwise(F.coalesce("kind", F.lit("unknown")))
    effect = _lookup(EFFECTS, kind, "")
    notes = F.array_compact(F.array(F.when(F.col("blocked"), BLOCKED_NOTE), F.lit(STATIC_NOTE), F.when(effect != "", F.concat(F.lit("Archetype: "), kind, F.lit(". "), effect))))
    return df.select("site", "access", kind.alias("archetype"), notes.alias("notes"))


def warnings(found: DataFrame, sums: DataFrame, passed: DataFrame, recs: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """site, check, detail: rows where a report contradicts itself; none for a sound one.

    Totals and severities reconcile with the findings; findings are complete; no defect comes twice;
    checks are known; no wording is prohibited or gives orders; limitations are declared; no action
    names the page of another finding; nothing that passed is advised on.
    """
    c = F.col
    row = lambda df, check, detail: df.select("site", F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    counted = found.groupBy("site").agg(F.count("*").alias("n"))
    both = sums.withColumn("buckets", sum((c(s) for s in SEVERITIES), F.lit(0))).join(counted, "site", "full")
    out = [
        row(both.where("not (total <=> n)"), "summary_reconciles", c("total")), row(both.where("not (buckets <=> n)"), "severity_counts_reconcile", c("buckets")),
        row(passed.join(found.select("site", "check_id").unionByName(recs.select("site", "check_id")).distinct(), ["site", "check_id"], "left_semi"), "passed_and_advised", c("check_id")),
    ]
    if "title" in found.columns:
        lacks = F.array_compact(F.array(*[F.when(F.coalesce(c(x).cast("string"), F.lit("")) == "", x) for x in ("finding_id", "title", "severity", "evidence")]))
        out.append(row(found.withColumn("lacks", F.explode(lacks)), "finding_complete", F.concat(c("check_id"), F.lit(" lacks "), c("lacks"))))
        out.append(row(found.groupBy("site", "check_id", "defect_key").agg(F.count("*").alias("m")).where("m > 1"), "no_duplicate_findings", F.concat(c("check_id"), F.lit(" "), c("defect_key"))))
    every = found.select("site", "check_id", F.lit(None).cast("string").alias("summary")).unionByName(recs.select("site", "check_id", (c("summary") if "summary" in recs.columns else F.lit(None).cast("string")).alias("summary")))
    out.append(row(every.where(~c("check_id").isin(*TITLES)), "known_check_id", c("check_id")))
    out.append(row(every.where(is_prohibited(c("summary")) | is_prescriptive(c("summary"))), "prohibited_recommendation", c("check_id")))
    if limits is not None:
        some = found.select("site").unionByName(sums.select("site")).distinct()
        have = limits.groupBy("site").agg(F.collect_set(F.when(c("lim_id").isin(*LIMITATIONS), c("lim_id"))).alias("have"))
        less = some.join(have, "site", "left").withColumn("less", F.array_except(F.array(*map(F.lit, LIMITATIONS)), F.coalesce("have", F.array().cast("array<string>"))))
        out.append(row(less.where(F.size("less") > 0), "limitations_present", F.array_join("less", ", ")))
    if "action" in found.columns:
        tail = lambda u: F.lower(F.coalesce(F.try_element_at(F.filter(urls.segments(u), lambda s: F.length(s) > 2), F.lit(-1)), F.lit("")))
        named = found.select("site", "check_id", "url", F.lower("action").alias("said"), F.when(tail(c("url")) != "", tail(c("url"))).otherwise(urls.host(c("url"))).alias("own")).where("url is not null and said <> ''")
        other = found.select("site", c("url").alias("elsewhere"), tail(c("url")).alias("tail")).where("tail <> ''").distinct()
        astray = named.where(~c("said").contains(c("own"))).join(other, "site").where((c("url") != c("elsewhere")) & c("said").contains(c("tail")))
        out.append(row(astray.select("site", "check_id", "url").distinct(), "action_locus_coherence", F.concat(c("check_id"), F.lit(" at "), c("url"))))
    return reduce(DataFrame.unionByName, out)


def reports(envelopes: DataFrame, found: DataFrame, recs: DataFrame, sums: DataFrame, passed: DataFrame, **more: DataFrame) -> DataFrame:
    """One nested row for every site with an envelope: summary, findings, recommendations, passed checks,
    and for each table in more (with a column site) an array of its rows."""
    listed = lambda df, key, name: df.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in df.columns if c not in ("site", key)]))).alias(name))
    parts = [listed(found, "finding_id", "findings"), listed(recs, "rec_id", "recommendations"), sums, passed.groupBy("site").agg(F.array_sort(F.collect_list("check_id")).alias("checks_passed"))]
    parts += [listed(df, next(c for c in df.columns if c != "site"), name) for name, df in more.items()]
    out = envelopes.select("site").distinct()
    for part in parts:
        out = out.join(part, "site", "left")
    return out


def is_prescriptive(words: Column) -> Column:
    """Whether a text gives orders or markup, by literal markers in either case."""
    low = F.lower(F.coalesce(words, F.lit("")))
    return F.exists(F.array(*[F.lit(m.lower()) for m in (*PRESCRIPTIVE, *MARKUP)]), lambda m: low.contains(m))


def is_prohibited(words: Column) -> Column:
    """Whether a text promises outcomes or cites figures that a report must not."""
    w = F.coalesce(words, F.lit(""))
    hit = F.lit(False)
    for pattern in PROHIBITED:
        hit = hit | w.rlike(pattern)
    return hit


def gate_wording(recs: DataFrame, summary_col: str = "summary") -> tuple[DataFrame, DataFrame]:
    """recs whose summary isn't empty and gives no orders, and warnings (site, check, detail) for the others."""
    words = F.col(summary_col)
    empty = F.trim(F.coalesce(words, F.lit(""))) == ""
    why = F.when(is_prescriptive(words), "prescriptive_wording").when(empty, "empty_summary")
    some = recs.withColumn("check", why)
    dropped = some.where("check is not null").select("site", "check", F.col("rec_id").alias("detail"))
    advised = recs.where(is_prohibited(words)).select("site", F.lit("prohibited_wording").alias("check"), F.col("rec_id").alias("detail"))
    return some.where("check is null").drop("check"), dropped.unionByName(advised)


def drop_contradicted(recs: DataFrame, strengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """recs that no strength (site, detector) of their site contradicts, and a warning for each of the others."""
    spoken = F.create_map(*[x for k, v in CONTRADICTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    against = strengths.where(F.col("detector").isin(*CONTRADICTED)).select("site", F.explode(F.try_element_at(spoken, F.col("detector"))).alias("check_id")).distinct()
    gone = recs.join(against, ["site", "check_id"], "left_semi")
    return recs.join(against, ["site", "check_id"], "left_anti"), gone.select("site", F.lit("contradicted_by_strength").alias("check"), F.col("rec_id").alias("detail"))


def uncovered(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """Single rows (site, check_id, defect_key, url) that no site-wide row covers; covered is instances()."""
    return rows.join(covered.select("site", "check_id", "defect_key", "url").distinct(), ["site", "check_id", "defect_key", "url"], "left_anti")


def evidence_date(text: Column) -> Column:
    """An ISO-8601 date or time as a timestamp, UTC where no zone is given; null for anything else."""
    t = F.regexp_replace(F.trim(text), r"^(.{10}[T ]\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    zoned = t.rlike(r"(Z|[+-]\d{2}:\d{2})$") & (F.length(t) > 10)
    return F.when(iso, F.try_to_timestamp(F.when(zoned, t).when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z")))))


def strengths(pages: DataFrame, access: DataFrame, sitemaps: DataFrame, audited_at: Column) -> DataFrame:
    """site, strength_id, detector, evidence: what a site does well, numbered S-1, ... over those that hold.

    pages are extracted ones that could be fetched, access is root_access() of the sites' robots,
    sitemaps is (site, page_type, lastmod timestamp) of inventory rows that a sitemap gave. A date
    in the future, or none, is not fresh.
    """
    c = F.col
    named = lambda x: F.size(F.array_intersect(x["fields"], F.array(F.lit("name"), F.lit("url")))) == 2
    who = F.exists("json_ld", lambda x: ~x["parse_error"] & named(x) & F.exists(x["types"], lambda t: t.endswith("organization") | t.isin("person", "localbusiness", "corporation", "ngo", "nonprofit")))
    first = lambda holds, value: F.min_by(F.when(holds, value), F.when(holds, c("ord")))
    own = c("canonical").isNotNull() & c("canonical_self") & ~c("canonical_cross")
    markdown = F.lower(F.regexp_extract("url", r"^([^?#]*)", 1)).endswith(".md")
    per = pages.groupBy("site").agg(
        first(F.size("feeds") > 0, F.get("feeds", F.lit(0))).alias("feed"), first(F.coalesce(who, F.lit(False)), c("url")).alias("identity"), F.count("*").alias("n"),
        F.count_if(own).alias("own"), first(markdown, c("url")).alias("markdown"),
    )
    may = access.where("allowed_root and class in ('retrieval', 'hybrid')").groupBy("site").agg(F.min("agent").alias("agent"))
    maps = sitemaps.groupBy("site").agg(F.count_distinct("page_type").alias("kinds"), F.max("lastmod").alias("latest"))
    df = per.join(may, "site", "full").join(maps, "site", "full")
    age = F.unix_timestamp(audited_at) - F.unix_timestamp("latest")
    said = lambda name, holds, text: F.when(holds, F.struct(F.lit(name).alias("detector"), text.cast("string").alias("evidence")))
    ratio = F.concat_ws("/", c("own").cast("string"), c("n").cast("string"))
    slots = F.array(
        said("sitemap_fresh", (c("kinds") > 5) & (age >= 0) & (age < 90 * 86400), c("latest")), said("feed_discovery", c("feed").isNotNull(), c("feed")),
        said("identity_jsonld", c("identity").isNotNull(), c("identity")),
        F.coalesce(said("canonical_consistency", (c("n") >= 3) & (c("own") == c("n")), ratio), said("canonical_majority", (c("n") >= 3) & (c("own") >= 3) & (c("own") * 3 >= c("n") * 2), ratio)),
        said("retrieval_crawler_access", c("agent").isNotNull(), c("agent")), said("content_negotiation", c("markdown").isNotNull(), c("markdown")),
    )
    return df.select("site", F.posexplode(F.array_compact(slots)).alias("k", "s")).select("site", F.concat(F.lit("S-"), c("k") + 1).alias("strength_id"), "s.*")
