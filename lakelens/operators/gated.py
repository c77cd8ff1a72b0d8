"""Checks that depend on what kind of site it is: identity, markup of its trade, trust signals, dates.

sites is a table (site, archetype, scheme, canonical_host). Every check gives one row for each of
its sites; a kind of site that a check isn't meant for is not_applicable, and a site whose pages
couldn't be read is not_determinable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .checks import _row, identity_pages
from .rendered import _exploded, home_pages

# --- fixed values -------------------------------------------------------------------------------
PERSONAL = ("personal", "hobby", "portfolio")
COMMERCIAL = ("ecommerce", "saas_marketing", "news_editorial", "local_business")
ORGANISATIONS = ("organization", "localbusiness", "corporation", "ngo", "educationalorganization", "governmentorganization", "nonprofit")
ARTICLES = ("article", "blogposting", "newsarticle", "report", "analysisnewsarticle")
LEGAL_SUFFIXES = r"\b(ltd|limited|llc|inc|incorporated|corp|corporation|gmbh)\b"
HOST_PARTS = ("www", "com", "org", "net", "co", "io", "dev", "app", "blog", "docs", "shop")
CATEGORY = (
    r"(?i)\b(?:agency|application|app|author|blog|business|community|company|consultant|"
    r"corporation|developer|designer|engineer|engine|foundation|framework|institute|"
    r"institution|journalist|library|magazine|manufacturer|marketplace|network|newspaper|"
    r"nonprofit|non-profit|organisation|organization|platform|project|provider|publication|"
    r"publisher|researcher|restaurant|retailer|school|service|shop|site|software|store|"
    r"studio|tool|university|website)\b"
)
FUNCTION = (
    r"(?i)\b(?:allow(?:s|ed|ing)?|build(?:s|ing)?|connect(?:s|ed|ing)?|creat(?:e|es|ed|ing)|"
    r"deliver(?:s|ed|ing)?|develop(?:s|ed|ing)?|enable(?:s|d|ing)?|focus(?:es|ed|ing)?|"
    r"help(?:s|ed|ing)?|host(?:s|ed|ing)?|inform(?:s|ed|ing)?|maintain(?:s|ed|ing)?|"
    r"make(?:s|made|making)?|offer(?:s|ed|ing)?|operat(?:e|es|ed|ing)|organis(?:e|es|ed|ing)|"
    r"organiz(?:e|es|ed|ing)|power(?:s|ed|ing)?|provid(?:e|es|ed|ing)|publish(?:es|ed|ing)?|"
    r"report(?:s|ed|ing)?|search(?:es|ed|ing)?|sell(?:s|ing)?|serv(?:e|es|ed|ing)|"
    r"speciali[sz](?:e|es|ed|ing)|support(?:s|ed|ing)?|teach(?:es|ing)?|lets?)\b"
)
TITLE_PARTS = r"\s*(?:\||—|–|:|\s+-\s+)\s*"
#: Account pages by host: patterns of the path, and hosts with one segment that isn't reserved and no query.
PROFILE_PATH = {
    "linkedin.com": r"^/(in|company|school|pub)/.", "www.linkedin.com": r"^/(in|company|school|pub)/.", "mastodon.social": r"^/@.", "wikipedia.org": r"/wiki/", "en.wikipedia.org": r"/wiki/",
    "youtube.com": r"^(/@[^/]+/?|/(channel|c|user)/[^/]+.*)$", "www.youtube.com": r"^(/@[^/]+/?|/(channel|c|user)/[^/]+.*)$",
}
PROFILE_RESERVED = {
    "github.com": "about pricing features topics issues pulls marketplace explore notifications login join search settings enterprise sponsors codespaces security organizations",
    "www.github.com": "about pricing features topics issues pulls marketplace explore notifications login join search settings",
    "twitter.com": "home explore notifications messages search login signup i intent share compose tos privacy about",
    "x.com": "home explore notifications messages search login signup i intent share compose tos privacy about",
    "instagram.com": "explore reels stories tv p accounts direct about",
    "www.instagram.com": "explore reels stories tv p accounts direct about",
    "facebook.com": "share sharer dialog tr help login watch reel story.php events marketplace gaming messages notifications settings business",
    "www.facebook.com": "share sharer dialog tr help login watch reel story.php events marketplace gaming messages notifications settings business",
}
LISTING_PATH = r"(?i)/(jobs?|events?|listings?|hackathons?|competitions?|challenges?|marketplace|browse)(/|$)"
ARCHIVE = r"(?i)\b(code repository|source code|software archive|dataset|data catalogue|data catalog|open data|code archive)\b|/(datasets?|data-catalog|repositories|source)(/|$)"
TEMPORAL = r"(?i)\b(announced|released|launched|updated|published|last week|yesterday|this (week|month|quarter)|in Q[1-4]|recently)\b"
YEAR_IN_URL = r"/(19|20)\d{2}([/-]|\b)"
# ------------------------------------------------------------------------------------------------
SITE_SEQ, TRADE_SEQ, ANCHOR_SEQ = 4 << 40, 5 << 40, (4 << 40) + 50


def _of(entities: Column, types) -> Column:
    return F.filter(entities, lambda x: F.arrays_overlap(x["types"], F.array(*map(F.lit, types))))


def _value(raw: Column, field: str) -> Column:
    """A field's text; null where it is missing or says nothing."""
    v = F.get_json_object(raw, f"$.{field}")
    return F.when(~F.trim(v).isin("", "[]", "{}", "0", "false"), v)


def _members(raw: Column, field: str) -> Column:
    """A field as an array of variants, whether it holds one value or a list."""
    v = F.try_parse_json(raw)
    return F.coalesce(F.try_variant_get(v, f"$.{field}", "array<variant>"), F.array(F.try_variant_get(v, f"$.{field}", "variant")))


def _priced(v: Column) -> Column:
    at = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    return ((at("price") != "") | (at("lowPrice") != "")) & ~at("priceCurrency").isin("", "0", "false")


def complete_offer(raw: Column) -> Column:
    """Whether an entity's own fields, as JSON, give a price and its currency."""
    return F.coalesce(_priced(F.try_parse_json(raw)), F.lit(False))


def normal_name(name: Column) -> Column:
    """Lower case, without full stops, commas and legal suffixes; dotted ones lose their stops first and stay."""
    n = F.regexp_replace(F.lower(F.trim(name)), "[.,]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(n, LEGAL_SUFFIXES, ""), r"\s+", " "))


def is_profile(url: Column) -> Column:
    """Whether a URL has the shape of an account's page on a known host."""
    host, path, parts = urls.host(url), urls.path(url), urls.segments(url)
    pairs = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    shape, reserved = F.try_element_at(pairs(PROFILE_PATH), host), F.split(F.try_element_at(pairs(PROFILE_RESERVED), host), " ")
    account = (F.size(parts) == 1) & ~F.array_contains(reserved, F.get(parts, F.lit(0))) & (urls.query(url) == "")
    return F.coalesce(F.when(shape.isNotNull(), F.regexp_like(path, shape)).when(reserved.isNotNull(), account), F.lit(False))


def anchor_urls(pages: DataFrame) -> DataFrame:
    """(site, url): distinct addresses that the identity pages of a site declare as its own elsewhere."""
    read = identity_pages(pages).where("extraction_ok")
    same = F.flatten(F.transform(_of(F.col("json_ld"), ORGANISATIONS), lambda e: F.transform(_members(e["raw"], "sameAs"), lambda v: F.trim(v.try_cast("string")))))
    shaped = F.transform(F.filter("links", lambda x: ~x["internal"] & is_profile(x["href"])), lambda x: x["href"])
    every = read.select("site", F.explode(F.concat(F.coalesce("profile_links", F.array().cast("array<string>")), F.coalesce(same, F.array().cast("array<string>")), shaped)).alias("url"))
    return every.where(F.col("url").startswith("http")).distinct()


def anchor_envelopes(pages: DataFrame, sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """Envelopes of declared identity addresses that don't resolve (D-026), a row for each site.

    resolved is sections.anchors(); only addresses that the identity pages declare are judged.
    """
    c = F.col
    meant = resolved.join(anchor_urls(pages), ["site", "url"], "left_semi")
    per = meant.groupBy("site").agg(F.count("*").alias("n"), F.count("resolved").alias("told"), F.count_if(~c("resolved")).alias("bad"))
    surfaces = identity_pages(pages).groupBy("site").agg(F.bool_or("extraction_ok").alias("any_read"))
    df = sites.join(per, "site", "left").join(surfaces, "site", "left").withColumn("url", F.lit(None).cast("string"))
    exempt = F.coalesce(c("archetype"), F.lit("unknown")).isin(*PERSONAL)
    state = F.when(exempt, "not_applicable").when(~F.coalesce("any_read", F.lit(False)) | (F.coalesce("told", F.lit(0)) == 0), "not_determinable").when(c("bad") > 0, "present").otherwise("absent")
    severity = F.when(state == "present", F.when(c("bad") == c("told"), "high").otherwise("medium"))
    said = F.concat(c("bad").cast("string"), F.lit(" of "), c("n").cast("string"), F.lit(" declared addresses did not resolve"))
    return _exploded(df, F.lit(ANCHOR_SEQ), [_row("CHK-D-026", state, severity, "HARD-MECHANICAL", False, "anchors_unresolved", F.coalesce("bad", F.lit(0)), said)])


def signal_score(text: Column, names: Column) -> Column:
    """0 to 3: a name of the site, a word for its category, and one for what it does."""
    bare = lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    named = F.exists(names, lambda n: (F.length(bare(n)) >= 3) & F.concat(F.lit(" "), bare(text), F.lit(" ")).contains(F.concat(F.lit(" "), bare(n), F.lit(" "))))
    return F.coalesce(named.cast("int") + text.rlike(CATEGORY).cast("int") + text.rlike(FUNCTION).cast("int"), F.lit(0))


def _strings(column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def identity_envelopes(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Envelopes of D-006, D-007, D-025, D-027 and E-024, a row for each site and check."""
    c = F.col
    kind = F.coalesce(c("archetype"), F.lit("unknown"))
    personal, vague = kind.isin(*PERSONAL), kind.isin("unknown", "brochure")
    own_name = lambda raws: F.filter(F.transform(raws, lambda x: F.trim(_value(x["raw"], "name"))), lambda n: n != "")
    named = pages.select("site", F.concat(own_name(_of(c("json_ld"), ORGANISATIONS)), F.array_compact(F.array(F.trim("footer_org")))).alias("n")).groupBy("site").agg(F.array_distinct(F.flatten(F.collect_set("n"))).alias("names"))
    trust = pages.where("page_type in ('home', 'about', 'contact')").groupBy("site").agg(F.bool_or(c("email") | c("phone").isNotNull()).alias("reachable"))

    raw_surfaces = identity_pages(pages)
    org = _of(c("json_ld"), ORGANISATIONS)
    same = F.exists(org, lambda e: F.exists(_members(e["raw"], "sameAs"), lambda v: F.coalesce(F.trim(v.try_cast("string")).startswith("http"), F.lit(False))))
    shaped = F.exists("links", lambda x: ~x["internal"] & x["href"].startswith("http") & is_profile(x["href"]))
    ok = c("extraction_ok")
    surfaces = raw_surfaces.groupBy("site").agg(
        F.bool_or("extraction_ok").alias("any_read"), F.bool_or(ok & F.coalesce(same | (F.size("profile_links") > 0) | shaped, F.lit(False))).alias("anchored"),
        F.flatten(F.collect_list(F.when(ok, F.concat(own_name(org), F.array_compact(F.array(c("footer_org"))))))).alias("said"),
    )
    df = home_pages(pages).join(sites, "site", "left").join(named, "site", "left").join(trust, "site", "left").join(surfaces, "site", "left")

    home_org, people = _of(c("home.json_ld"), ORGANISATIONS), _of(c("home.json_ld"), ("person",))
    title = F.trim(F.coalesce("home.title", F.lit("")))
    prefix = F.trim(F.get(F.split(title, TITLE_PARTS, 2), F.lit(0)))
    short = F.when((prefix != "") & (F.size(F.split(prefix, r"\s+")) <= 5) & (F.length(prefix) <= 60), prefix)
    labels = F.filter(F.split(F.lower(F.coalesce("canonical_host", F.lit(""))), r"\."), lambda x: (F.length(x) >= 3) & ~x.isin(*HOST_PARTS))
    names = F.concat(_strings("names"), labels, F.array_compact(F.array(short)), F.when(personal, _strings(own_name(people))).otherwise(_strings(F.lit(None))))
    df = df.withColumn("known_names", names)
    hero = F.coalesce("home.hero", F.lit(""))
    h1 = F.coalesce(F.get(F.filter("home.headings", lambda h: (h["level"] == 1) & (h["text"] != "")), F.lit(0))["text"], F.lit(""))
    joined = lambda raw, fields: F.concat_ws(" ", *[F.coalesce(_value(raw, f), F.lit("")) for f in fields])
    texts = F.concat(
        F.array(h1, hero, F.coalesce("home.description", F.lit("")), F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(hero, F.lit("")))),
        _strings(F.transform(home_org, lambda e: joined(e["raw"], ("name", "description")))),
        F.when(personal, _strings(F.transform(people, lambda e: joined(e["raw"], ("name", "description", "jobTitle"))))).otherwise(_strings(F.lit(None))),
    )
    told = F.exists(texts, lambda t: signal_score(t, c("known_names")) >= 2)
    unread = c("home").isNull() | ~F.coalesce("home.extraction_ok", F.lit(False))
    d006 = F.when(vague, "not_applicable").when(unread, "not_determinable").when(told, "absent").when(personal, "not_applicable").otherwise("present")
    first = F.get(home_org, F.lit(0))
    whole = F.size(F.array_intersect(first["fields"], F.array(F.lit("name"), F.lit("url")))) == 2
    d007 = F.when(vague | personal, "not_applicable").when(unread, "not_determinable").when(F.coalesce(whole, F.lit(False)), "absent").otherwise("present")
    d025 = F.when(personal, "not_applicable").when(~F.coalesce("any_read", F.lit(False)), "not_determinable").when(c("anchored"), "absent").otherwise("present")
    said = F.array_sort(F.array_distinct(F.filter(F.transform(_strings("said"), normal_name), lambda n: n != "")))
    agree = (F.size(said) <= 1) | F.forall(said, lambda n: n.contains(F.get(said, F.lit(0))))
    d027 = F.when(F.size(_strings("said")) < 2, "not_determinable").when(agree, "absent").otherwise("present")
    lacks = F.array_compact(F.array(F.when(~F.coalesce("reachable", F.lit(False)), "contact"), F.when(F.coalesce("scheme", F.lit("")) != "https", "https")))
    e024 = F.when(~kind.isin(*COMMERCIAL), "not_applicable").when(F.size(lacks) > 0, "present").otherwise("absent")
    at = lambda state, severity: F.when(state == "present", severity)
    rows = [
        _row("CHK-D-006", d006, at(d006, "medium"), "CORRELATIONAL", True, "identity"),
        _row("CHK-D-007", d007, at(d007, "medium"), "THEORETICAL/PRACTITIONER", True, F.when(first.isNull(), "missing").otherwise("incomplete")),
        _row("CHK-D-025", d025, at(d025, "medium"), "CORRELATIONAL", False, "anchors"),
        _row("CHK-D-027", d027, None, "THEORETICAL", True, "names"),
        _row("CHK-E-024", e024, None, "CORRELATIONAL", True, F.array_join(lacks, "+")),
    ]
    return _exploded(df.withColumn("url", c("home.url")), F.lit(SITE_SEQ), rows)


def trade_envelopes(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Envelopes of the markup that suits a trade: D-029 to D-034, a row for each site and check."""
    c, no = F.col, F.lit(False)
    some = lambda types, f: F.coalesce(F.exists(_of(c("json_ld"), types), lambda e: F.coalesce(f(e["raw"]), no)), no)
    has = lambda raw, *fields: [_value(raw, f).isNotNull() for f in fields]
    every = lambda raw, *fields: F.array_min(F.array(*has(raw, *fields)))
    either = lambda raw, *fields: F.array_max(F.array(*has(raw, *fields)))
    offers = some(("offer", "aggregateoffer"), complete_offer)
    product = some(("product",), lambda raw: every(raw, "name") & F.exists(_members(raw, "offers"), _priced)) | offers
    app = some(("softwareapplication", "webapplication"), lambda raw: every(raw, "name") & either(raw, "applicationCategory", "operatingSystem", "offers"))
    app = app | some(("offer", "aggregateoffer", "pricing"), complete_offer)
    listing = (
        some(("event",), lambda raw: every(raw, "name", "startDate", "location")) | some(("itemlist",), lambda raw: every(raw, "itemListElement"))
        | some(("jobposting",), lambda raw: every(raw, "title", "datePosted", "hiringOrganization"))
    )
    author = lambda raw: F.filter(F.transform(_members(raw, "author"), lambda a: F.try_variant_get(a, "$.name", "string")), lambda n: n != "")
    news = some(("newsarticle",), lambda raw: every(raw, "datePublished", "headline") & (F.size(author(raw)) > 0))
    persons = F.filter(F.transform(_of(c("json_ld"), ("person",)), lambda e: normal_name(_value(e["raw"], "name"))), lambda n: n.isNotNull())
    bylines = F.flatten(F.transform(_of(c("json_ld"), ARTICLES), lambda e: F.transform(author(e["raw"]), normal_name)))
    archive = F.concat_ws(" ", "url", "title", F.substring("main_text", 1, 1500)).rlike(ARCHIVE)
    code = some(("softwaresourcecode",), lambda raw: every(raw, "name") & either(raw, "codeRepository", "programmingLanguage")) | some(("datacatalog",), lambda raw: every(raw, "name", "dataset"))
    ok, kind = c("extraction_ok"), c("page_type")
    flags = pages.select(
        "site", "ord", "url", (ok & (kind == "product")).alias("p029"), product.alias("v029"), (ok & kind.isin("home", "pricing")).alias("p030"), app.alias("v030"),
        (ok & ((kind == "category") | c("url").rlike(LISTING_PATH))).alias("p031"), listing.alias("v031"), (ok & (kind == "article")).alias("p032"), news.alias("v032"),
        (ok & archive).alias("p034"), code.alias("v034"), F.when(ok, persons).alias("persons"), F.when(ok & (kind == "article"), bylines).alias("bylines"),
        (F.size("feeds") > 0).alias("feed"), ok.alias("ok"),
    )
    all_ok = lambda n: F.coalesce(F.bool_and(F.when(c(f"p{n}"), c(f"v{n}"))), no).alias(f"all{n}")
    any_ok = lambda n: F.coalesce(F.bool_or(c(f"p{n}") & c(f"v{n}")), no).alias(f"any{n}")
    per = flags.groupBy("site").agg(
        F.min_by("url", F.when(c("ok"), c("ord"))).alias("url"), all_ok("029"), any_ok("030"), any_ok("031"), all_ok("032"), any_ok("034"), F.bool_or("p034").alias("archives"),
        F.bool_or("feed").alias("feed_any"), F.bool_or(c("feed") & c("ok")).alias("feed_ok"),
        F.array_distinct(F.flatten(F.collect_set("persons"))).alias("persons"), F.collect_set("bylines").alias("bylines"),
    )
    df = per.join(sites.select("site", "archetype"), "site", "left")
    a = F.coalesce(c("archetype"), F.lit("unknown"))
    consistent = F.forall("bylines", lambda b: F.arrays_overlap(b, c("persons")))
    state = lambda meant, good: F.when(~meant, "not_applicable").when(good, "absent").otherwise("present")
    verdicts = {
        "029": state(a == "ecommerce", c("all029")), "030": state(a == "saas_marketing", c("any030")), "031": state(a == "marketplace", c("any031")),
        "032": state(a == "news_editorial", c("all032") & c("feed_any")), "033": state(a.isin(*PERSONAL), (F.size("persons") > 0) & c("feed_ok") & F.coalesce(consistent, no)),
        "034": state(a.isin("reference", "institutional") & c("archives"), c("any034")),
    }
    rows = [_row(f"CHK-D-{n}", s, F.when(s == "present", "low"), "NORMATIVE/PRACTITIONER", True, "trade_markup") for n, s in verdicts.items()]
    return _exploded(df, F.lit(TRADE_SEQ), rows)


def date_envelopes(pages: DataFrame) -> DataFrame:
    """Envelopes of D-012: pages about current matters without any date; evergreen pages make no row."""
    c = F.col
    visible = F.size("times") > 0
    timely = (
        (c("page_type").isin("article", "documentation", "faq") & c("url").rlike(YEAR_IN_URL)).cast("int") + (c("published").isNotNull() | visible).cast("int")
        + (F.regexp_count(F.substring("main_text", 1, 1200), F.lit(TEMPORAL)) >= 3).cast("int")
    ) >= 2
    said = lambda name: F.coalesce(c(name), F.lit("")) != ""
    dated = said("header_last_modified") | said("published") | said("jsonld_published") | said("jsonld_modified") | visible | urls.url_date(c("url")).isNotNull()
    state = F.when(~c("extraction_ok"), "not_determinable").when(dated, "absent").otherwise("present")
    rows = [F.when(~c("extraction_ok") | timely, _row("CHK-D-012", state, F.when(state == "present", "low"), "THEORETICAL", False, "undated"))]
    return _exploded(pages, c("ord").cast("long") * 100 + 80, rows)
