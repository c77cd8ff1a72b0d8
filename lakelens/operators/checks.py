"""Page and site checks over extracted pages, as rows of envelopes.

Page checks are one projection that makes an array of envelopes, then a generator: no shuffle. An
envelope is (site, seq, url, check_id, state, severity, strength, recommendation, defect_key, violations, evidence).
States: present, absent, not_determinable, not_applicable, suppressed. Pages that couldn't be had or
read are never present or absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..sources.tables import stored

# --- fixed values -------------------------------------------------------------------------------
VAGUE_LINKS = ("click here", "here", "read more", "more", "learn more", "this link", "details", "info", "click", "tap", "view", "see")
VAGUE_HEADINGS = "(?i)^(more|details|info|learn more|read more)$"
NO_SPACES = "(?i)^(ja|zh|ko|th|lo|km|my|bo)([-_].*)?$"
HIERARCHICAL, PERSONAL = ("ecommerce", "news_editorial", "documentation"), ("personal", "hobby", "portfolio")
NON_INFORMATIONAL = ("contact", "login", "home")
FORM_URL = r"(?i)/(contact|contact-us|contact-form|get-in-touch|login|signin|sign-in|log-in)(/|$|\?)"
#: Kinds of accessibility violations in static markup, and what would serve a page that has them.
VIOLATIONS = ("missing lang attribute", "missing alt on a non-decorative image", "link with no accessible name", "button with no accessible name", "unlabelled form control")
REMEDIES = ("a declared page language", "descriptive alternative text for informative images", "accessible names for links", "accessible names for buttons", "programmatic labels for form controls")
# ------------------------------------------------------------------------------------------------


def remedies(evidence: Column) -> Column:
    """What a page would benefit from, by the violations that its evidence names, each once and in order; null if none."""
    wanted = F.array_compact(F.array(*[F.when(evidence.contains(v), r) for v, r in zip(VIOLATIONS, REMEDIES, strict=True)]))
    return F.when(F.size(wanted) > 0, F.array_join(wanted, "; "))


def typed(pages: DataFrame) -> DataFrame:
    """pages with page_type, from URL, title and structured types."""
    bare = F.array_distinct(F.transform(F.flatten(F.transform("json_ld", lambda x: x["types"])), lambda t: F.regexp_extract(t, r"([^/:#]*)/?$", 1)))
    return pages.withColumn("page_type", urls.page_type(F.col("url"), F.col("title"), bare))


#: Places of the analysers' site-wide rows in the order of a report; page rows have ord * 100 + k below each base.
LINKS_SEQ, DUPLICATES_SEQ, SHIFT_SEQ = (1 << 40) - 3, (1 << 40) - 2, 1 << 40


def _row(check: str, state: Column, severity, strength: str | Column, recommendation: bool, key: Column | str = "", violations: Column | int = 1, evidence: Column | None = None) -> Column:
    lift = lambda x: x if isinstance(x, Column) else F.lit(x)
    said = F.concat(lift(key).cast("string"), F.lit(": "), lift(violations).cast("string")) if evidence is None else evidence
    return F.struct(
        F.lit(check).alias("check_id"), state.alias("state"), lift(severity).cast("string").alias("severity"), lift(strength).alias("strength"),
        F.lit(recommendation).alias("recommendation"), lift(key).cast("string").alias("defect_key"), lift(violations).cast("int").alias("violations"),
        F.when(state == "present", said).alias("evidence"),
    )


def _state(fires: Column, unless: Column) -> Column:
    return F.when(unless, "not_determinable").when(fires, "present").otherwise("absent")


def page_envelopes(pages: DataFrame) -> DataFrame:
    """Envelopes of the page checks for typed() pages; a check that doesn't apply makes no row.

    What other pages or the kind of site say is added to the rows by with_context().
    """
    c, no = F.col, F.lit(False)
    lang = F.coalesce(c("lang"), F.lit(""))
    unread = ~c("extraction_ok")
    unmeasured = unread | c("js_render_suspected")
    paid = F.exists("json_ld", lambda x: F.lower(F.coalesce(F.get_json_object(x["raw"], "$.isAccessibleForFree"), F.lit(""))).isin("false", "no", "0"))
    alone = (F.size(urls.segments(c("url"))) == 1) & (F.get(urls.segments(c("url")), F.lit(0)).rlike(urls.VERSION_SEGMENT) | F.get(urls.segments(c("url")), F.lit(0)).rlike(urls.LOCALE_SEGMENT))
    informs = ~(c("page_type").isin(*NON_INFORMATIONAL) | c("url").rlike(FORM_URL) | F.coalesce(alone, no))
    thin = _state(c("words") < 200, unmeasured | lang.rlike(NO_SPACES) | paid)
    weak = F.when(thin == "present", "suppressed").when(unmeasured | ((lang != "") & ~lang.rlike("(?i)^en")), "not_determinable").when(~text.has_evidence(c("main_text")), "present").otherwise("absent")
    levels = F.transform("headings", lambda h: h["level"])
    headed = F.exists("headings", lambda h: h["level"].isin(2, 3) & ~F.trim(h["text"]).rlike(VAGUE_HEADINGS))
    canonical = ~c("canonical_self") & (c("canonical").isNull() | c("canonical_cross"))
    images = F.size(F.filter("images", lambda i: ~i["decorative"] & i["alt"].isNull()))
    bare = F.size(F.filter("controls", lambda x: ~x["labelled"]))
    zoom = F.lower(F.regexp_replace(F.coalesce(c("viewport"), F.lit("")), r"\s", ""))
    largest = F.regexp_extract(zoom, r"maximum-scale=([0-9.]+)", 1).try_cast("double")
    locked = zoom.rlike("user-scalable=(no|0)") | F.coalesce(largest < 2, no)
    n_links = F.size("links")
    vague = F.size(F.filter("links", lambda x: F.lower(F.trim(x["text"])).isin(*VAGUE_LINKS) & (F.coalesce(x["aria_label"], F.lit("")) == "")))
    skips = F.exists(F.zip_with(F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: b - a > 1), lambda x: x)
    h1 = F.size(F.filter(levels, lambda x: x == 1))
    parts = F.array_compact(F.array(F.when(c("n_main") == 0, "no_main"), F.when(skips, "heading_skip")))
    structure = F.when(h1 == 0, "no_h1").otherwise(F.array_join(parts, "+"))
    pronouns = text.pronoun_percent(c("main_text"))
    # One row a page: the page's language, each image and control, and links and buttons once each.
    found = [(c("lang").isNull().cast("int"), 0), (images, 1), ((c("links_no_text") > 0).cast("int"), 2), ((c("buttons_no_text") > 0).cast("int"), 3), (bare, 4)]
    violations = sum((n for n, _ in found), F.lit(0))
    named = F.array_join(F.array_compact(F.array(*[F.when(n > 0, VIOLATIONS[k]) for n, k in found])), "; ")
    wcag = _row("CHK-E-014", _state(violations > 0, unread), "high", "HARD-MECHANICAL", False, "wcag_static", violations, F.concat(violations.cast("string"), F.lit(" accessibility violation(s): "), named))
    rows = F.array(
        F.when(informs, _row("CHK-D-004", thin, "medium", "CORRELATIONAL", False, "thin")),
        F.when((c("words") > 500) & ~c("page_type").isin("legal", "faq"), _row("CHK-D-005", _state(~headed, unread), "low", "THEORETICAL", True, "no_subheadings")),
        _row("CHK-D-008", _state(canonical, unread), "medium", "NORMATIVE", True, F.when(c("canonical").isNull(), "missing").otherwise("cross_domain")),
        F.when(informs, _row("CHK-D-010", weak, None, "CORRELATIONAL", True, "no_evidence")),
        F.when(c("page_type").isin("home", "about"), _row("CHK-D-011", _state(F.coalesce(pronouns > 60, no), unmeasured), "low", "THEORETICAL/HEURISTIC", True, "pronouns")),
        wcag,
        _row("CHK-E-015", _state(c("viewport").isNull() | locked, unread), F.when(locked, "high").otherwise("medium"), "NORMATIVE", True, F.when(locked, "zoom_locked").otherwise("missing")),
        _row("CHK-E-017", _state(F.coalesce(F.bround(100 * vague / F.nullif(n_links, F.lit(0))) > 10, no), unread), "medium", "NORMATIVE/THEORETICAL", False, "vague_links"),
        _row("CHK-E-020", _state(F.exists("media", lambda m: m["autoplay"] & ~m["muted"] & ~m["controls"]), unread), "medium", "NORMATIVE", False, "autoplay"),
        _row("CHK-E-022", _state((h1 == 0) | (structure != ""), unread), "medium", "NORMATIVE/PRACTITIONER", False, structure),
    )
    each = pages.select("site", "ord", "url", F.posexplode(F.array_compact(rows)).alias("k", "e"))
    return each.select("site", (F.col("ord").cast("long") * 100 + F.col("k")).alias("seq"), "url", "e.*")


def _site_rows(df: DataFrame, seq: int, row: Column) -> DataFrame:
    """An envelope for each row (site, url, ...)."""
    return df.select("site", F.lit(seq).cast("long").alias("seq"), "url", row.alias("e")).select("site", "seq", "url", "e.*")


def shift_counts(pages: DataFrame) -> DataFrame:
    """site, url, count: images and frames of a page without any dimension, where there are some."""
    bare = lambda x: x["width"].isNull() & x["height"].isNull()
    n = F.size(F.filter("images", lambda i: bare(i) & ~i["in_picture"] & ~i["aspect"])) + F.size(F.filter("iframes", bare))
    return pages.select("site", "url", n.alias("count")).where("count > 0")


def site_envelopes(pages: DataFrame) -> DataFrame:
    """Envelopes of layout shift: three or more images or frames without dimensions on a site."""
    per = pages.select("site").distinct().join(shift_counts(pages).groupBy("site").agg(F.sum("count").alias("n"), F.min("url").alias("url"), F.count("*").alias("m")), "site", "left")
    n = F.coalesce("n", F.lit(0))
    said = F.concat(n.cast("string"), F.lit(" images or frames without dimensions on "), F.coalesce("m", F.lit(0)).cast("string"), F.lit(" pages"))
    return _site_rows(per, SHIFT_SEQ, _row("CHK-E-021", F.when(n >= 3, "present").otherwise("absent"), F.when(n >= 3, "low"), "THEORETICAL", True, "layout_shift", n, said))


def first_three(rows: DataFrame, keys: list[str], order: list, value: Column) -> DataFrame:
    """keys, examples: the first three values of each group. Within parts of a group first, so no task sorts a whole one."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    cut = lambda df, *by: df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r <= 3")
    few = cut(cut(salted, *keys, "__salt"), *keys).withColumn("__v", value)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", "__v"))).alias("x")).select(*keys, F.transform("x", lambda y: y["__v"]).alias("examples"))


def broken_links(links: DataFrame) -> DataFrame:
    """site, state, broken, first_three: links that answered 400 or more."""
    bad = links.where("http_status >= 400").withColumns({"from_page": F.coalesce("from_page", F.lit("")), "url": F.coalesce("url", F.lit(""))})
    per = links.groupBy("site").agg(F.count_if(F.col("http_status") >= 400).alias("broken"))
    three = first_three(bad.select("site", "from_page", "url", "http_status"), ["site"], ["from_page", "url", "http_status"], F.col("url"))
    return per.join(three, "site", "left").select("site", F.when(F.col("broken") > 0, "present").otherwise("absent").alias("state"), "broken", F.coalesce(F.array_join("examples", " "), F.lit("")).alias("first_three"))


def link_envelopes(links: DataFrame, sites: DataFrame) -> DataFrame:
    """Envelopes of broken internal links (D-009), a row for each site; sites without any checked link are not determinable."""
    bad = links.where("http_status >= 400").select("site", F.coalesce("from_page", F.lit("")).alias("from_page"), F.coalesce("url", F.lit("")).alias("url"), "http_status")
    said = F.concat(F.col("url"), F.lit(" responded "), F.col("http_status").cast("string"), F.lit(" from "), F.nullif(F.col("from_page"), F.lit("")))
    three = first_three(bad, ["site"], ["from_page", "url", "http_status"], F.struct(F.coalesce(F.nullif("from_page", F.lit("")), "url").alias("at"), F.coalesce(said, F.col("url")).alias("said")))
    per = links.groupBy("site").agg(F.count_if(F.col("http_status") >= 400).alias("broken"))
    df = sites.select("site").distinct().join(per, "site", "left").join(three, "site", "left").withColumn("url", F.get("examples", F.lit(0))["at"])
    state = F.when(F.col("broken").isNull(), "not_determinable").when(F.col("broken") > 0, "present").otherwise("absent")
    told = F.concat(F.col("broken").cast("string"), F.lit(" broken: "), F.array_join(F.transform("examples", lambda x: x["said"]), "; "))
    return _site_rows(df, LINKS_SEQ, _row("CHK-D-009", state, F.when(state == "present", "low"), "THEORETICAL/CORRELATIONAL", True, "broken_links", F.coalesce("broken", F.lit(0)), told))


def _page_key(url: Column) -> Column:
    bare = F.regexp_replace(urls.path(url), "/+$", "")
    return F.concat(urls.host(url), F.when(bare == "", "/").otherwise(bare))


def aliases(pages: DataFrame) -> DataFrame:
    """(site, url): read pages of which another one is at the same host and path, or names it as its
    canonical, or is named by it."""
    read = pages.where("extraction_ok").select("site", "url", "canonical", _page_key(F.col("url")).alias("key")).distinct()
    twins = read.groupBy("site", "key").agg(F.count_distinct("url").alias("n")).where("n > 1").join(read, ["site", "key"]).select("site", "url")
    named = read.where(F.col("canonical") != F.col("url")).select("site", F.col("url").alias("by"), F.col("canonical").alias("url"))
    told = named.join(read.select("site", "url").distinct(), ["site", "url"])
    return twins.unionByName(told.select("site", "url")).unionByName(told.select("site", F.col("by").alias("url"))).distinct()


def with_context(envelopes: DataFrame, aliased: DataFrame, sites: DataFrame) -> DataFrame:
    """Envelopes of pages, with the strength of a canonical defect (CAUSAL on pages with an alias) and
    the severity of a missing h1 by the kind of site. Narrow rows are joined, never pages."""
    c = F.col
    kind = F.coalesce("archetype", F.lit("unknown"))
    untitled = F.when(kind.isin(*PERSONAL), "low").when(kind.isin(*HIERARCHICAL), "high").otherwise("medium")
    df = envelopes.join(sites.select("site", "archetype"), "site", "left").join(aliased.withColumn("aliased", F.lit(True)), ["site", "url"], "left")
    severity = F.when((c("check_id") == "CHK-E-022") & (c("defect_key") == "no_h1"), untitled).otherwise(c("severity"))
    strength = F.when((c("check_id") == "CHK-D-008") & (c("state") == "present") & c("aliased"), "CAUSAL").otherwise(c("strength"))
    return df.withColumns({"severity": severity, "strength": strength}).select(*envelopes.columns)


def duplicate_envelopes(pages: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Envelopes of near-duplicate pages (D-013), a row for each site.

    Fewer than three eligible pages, or likeness only among pages that scripts fill, tell nothing;
    two or more pairs are a recommendation, as is likeness among versions or languages alone.
    """
    eligible = _comparable(pages)
    sizes = pages.select("site").distinct().join(eligible.groupBy("site").agg(F.count("*").alias("n")), "site", "left")
    heavy = eligible.where("js_payload_heavy").select("site", "url").distinct()
    pairs = stored(near_duplicate_pages(pages, threshold))
    for side in ("url_a", "url_b"):
        pairs = pairs.join(heavy.select("site", F.col("url").alias(side), F.lit(True).alias(f"heavy_{side}")), ["site", side], "left")
    script = F.coalesce("heavy_url_a", "heavy_url_b", F.lit(False))
    kind = F.when(F.col("variant").isNotNull(), "variant").when(script, "script").otherwise("real")
    pairs = pairs.withColumn("kind", kind)
    per = pairs.groupBy("site").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("variant", "script", "real")], F.array_sort(F.collect_set("variant")).alias("variants"))
    real = pairs.where("kind = 'real'").select("site", "url_a", "url_b", "similarity")
    said = F.concat(F.col("url_a"), F.lit(" and "), F.col("url_b"), F.lit(" ("), F.bround(100 * F.col("similarity")).cast("int").cast("string"), F.lit("%)"))
    three = first_three(real, ["site"], [F.desc("similarity"), "url_a", "url_b"], F.struct(F.col("url_a").alias("at"), said.alias("said")))
    df = sizes.join(per, "site", "left").join(three, "site", "left").withColumn("url", F.when(F.col("real") >= 2, F.get("examples", F.lit(0))["at"]))
    n = lambda name: F.coalesce(name, F.lit(0))
    state = (
        F.when(n("n") < 3, "not_determinable").when((n("script") > 0) & (n("real") == 0), "not_determinable").when((n("real") >= 2) | (n("variant") > 0), "present").otherwise("absent")
    )
    key = F.when(n("real") >= 2, "near_duplicates").otherwise("variants")
    told = F.when(n("real") >= 2, F.concat(n("real").cast("string"), F.lit(" pairs: "), F.array_join(F.transform("examples", lambda x: x["said"]), "; "))).otherwise(F.concat(n("variant").cast("string"), F.lit(" pairs of variants: "), F.array_join("variants", ", ")))
    return _site_rows(df, DUPLICATES_SEQ, _row("CHK-D-013", state, F.when(state == "present", "low"), "CORRELATIONAL", True, key, F.when(n("real") >= 2, n("real")).otherwise(n("variant")), told))


def _comparable(pages: DataFrame) -> DataFrame:
    return pages.where("extraction_ok and not js_render_suspected and page_type <> 'legal'")


def near_duplicate_pages(pages: DataFrame, threshold: float = 0.8) -> DataFrame:
    """site, url_a, url_b, similarity, variant: pages of a site whose trigram sets are alike.

    An inverted join on trigrams: rare ones first, and only the prefix that a pair above the
    threshold must share, so common phrases don't pair all pages. Empty sets, legal pages and pages
    that scripts seem to fill don't take part. Every pair above the threshold is found.
    """
    c = F.col
    eligible = _comparable(pages).select("site", "ord", "url", F.xxhash64("site", "ord").alias("p"), "main_text")
    sets = eligible.select("site", "ord", "p", text.trigram_keys(c("main_text")).alias("t")).where(F.size("t") > 0)
    # From here to the pairs a row is a few numbers: g is a trigram of one site, m in how many of its pages it is.
    posted = sets.select("p", "ord", F.size("t").alias("n"), F.explode(F.transform("t", lambda t: F.xxhash64("site", t))).alias("g"))
    shared = posted.withColumn("m", F.count("*").over(Window.partitionBy("g"))).where("m > 1")
    # Trigrams of one page alone come first in its prefix, so what the prefix leaves over them is for shared ones.
    page = shared.groupBy("p", "ord", "n").agg(F.array_sort(F.collect_list(F.struct("m", "g"))).alias("s"))
    left_over = F.greatest(F.lit(0), F.size("s") - F.ceil(c("n") * threshold).cast("int") + 1)
    prefix = page.select("p", "ord", "n", F.explode(F.slice("s", F.lit(1), left_over)).alias("s")).select("p", "ord", "n", "s.g")
    a, b = prefix.alias("a"), prefix.alias("b")
    size = (c("a.n") > threshold * c("b.n")) & (c("b.n") > threshold * c("a.n"))
    pairs = a.join(b, (c("a.g") == c("b.g")) & (c("a.ord") < c("b.ord")) & size).select(c("a.p").alias("x"), c("b.p").alias("y")).distinct()
    pairs = stored(pairs)
    met = pairs.select(F.explode(F.array("x", "y")).alias("p")).distinct()
    met = eligible.join(met, "p", "left_semi").select("p", "site", "url", text.trigram_keys(c("main_text")).alias("t"))
    left = met.select(c("p").alias("x"), "site", c("url").alias("url_a"), c("t").alias("ta"))
    right = met.select(c("p").alias("y"), c("site").alias("site_b"), c("url").alias("url_b"), c("t").alias("tb"))
    both = pairs.join(left, "x").join(right, "y").where("site = site_b").withColumn("similarity", text.jaccard(c("ta"), c("tb"))).where(c("similarity") > threshold)
    return both.select("site", "url_a", "url_b", "similarity", urls.variant_kind(c("url_a"), c("url_b")).alias("variant"))


def identity_pages(pages: DataFrame) -> DataFrame:
    """Home pages, and the about and contact pages that a home page of their site links to."""
    home = pages.where("page_type = 'home'")
    linked = home.select("site", F.explode("links").alias("l")).where("l.internal").select("site", _page_key(F.col("l.href")).alias("k")).distinct()
    other = pages.where("page_type in ('about', 'contact')").withColumn("k", _page_key(F.col("url"))).join(linked, ["site", "k"], "left_semi").drop("k")
    return home.unionByName(other)
