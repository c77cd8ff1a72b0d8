"""What kind of site it is, by additive evidence.

Pages and links are folded into one row of signals for each site; a table of rules gives the weight
that each signal adds to a kind; the best kind wins if it has enough and is ahead far enough. Link
texts are counted page by page and paths by distinct rows, so no site's text is ever put together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from . import vocabulary
from .sampling import virtual_inventory

# --- fixed values -------------------------------------------------------------------------------
KINDS = ("ecommerce", "saas_marketing", "news_editorial", "documentation", "local_business", "reference", "institutional", "marketplace", "personal")
SHOP_PLATFORM = r"(?i)shopify|woocommerce|magento|bigcommerce|prestashop|opencart|salesforce commerce|demandware|shopware|squarespace commerce|wix stores|ecwid|volusion|3dcart|shift4shop"
DOC_GENERATOR = r"(?i)sphinx|mkdocs|docusaurus|gitbook|vuepress|vitepress|readthedocs|docsify|jekyll.*docs|just-the-docs|hugo.*(docsy|book|doks)|antora|slate|redoc|swagger|mintlify|readme\.io"
EDITORIAL_GENERATOR = r"(?i)wordpress|ghost|substack|medium|blogger|typepad|arc publishing|newspack"
CART_LINK = r"(?i)/(cart|basket|bag|shopcart|shopping-?cart|checkout/cart)(/|$|\?)|//(shopping)?cart\."
CART_TEXT = r"(?i)\b(cart|basket|checkout|add to (cart|bag|basket)|buy now|shop now|shop all)\b"
SAAS_TEXT = (
    r"(?i)\b(free trial|start (your )?free|try (it )?(for )?free|try free|request a demo|book a demo|get a demo|schedule a demo|watch demo|see pricing|view pricing|pricing|"
    r"plans and pricing|start for free|get started( for)? free|sign up( for)? free|open an account|create (a |your )?free account|talk to sales|contact sales|download the app|get the app)\b"
)
SAAS_LINK = r"(?i)/(pricing|plans|demo|request-demo|free-trial|trial|signup|sign-up|get-started|start-free)(/|$|\?)"
LOCAL_TEXT = (
    r"(?i)\b(order (online|now|ahead|delivery|pickup)|find a (store|location|restaurant|branch)|store locator|locations?|our menu|view menu|menu|reservations?|book a table|"
    r"opening hours|hours & locations|directions|visit us|nearest)\b"
)
LOCAL_LINK = r"(?i)/(locations?|store-?locator|find-a-store|restaurants?|menu|menus|order|reservations?|book|directions)(/|$|\?)"
MARKET_LINK = (
    r"(?i)/(jobs?|job-search|job-listings?|listings?|homes?|for-sale|for-rent|rentals?|apartments?|hotels?|flights?|vacation-rentals?|cruises?|classifieds|salaries|post-ad|"
    r"post-a-job|leaderboard|marketplace)(/|$|\?)"
)
MARKET_TEXT = (
    r"(?i)\b(post (a |an |your )?(ad|job|listing)|browse (jobs|listings|homes|hotels|rentals)|find (jobs|homes|hotels|apartments|flights|a rental)|"
    r"search (jobs|homes|hotels|flights|listings|rentals)|write a review|list your (property|business|home)|for sale|for rent|apply now|employers|hosts?|sellers?|"
    r"become a (host|seller|driver|partner))\b"
)
MARKET_CALL = (
    r"(?i)\b(post (a|an|your) (job|ad|listing)|become a (seller|host|creator|partner|driver)|list your (property|business|home|space)|for (sellers|creators|employers|hosts|artists)|"
    r"start selling|sell (your|on)|hire|apply now|find (a )?(freelancer|job|talent))\b"
)
INSTITUTION_LINK = (
    r"(?i)/(admissions?|academics?|students?|faculty|alumni|campus|research|departments?|programs?|donate|giving|foundation|grants?|missions?|agency|agencies|about-nasa|newsroom|"
    r"press-room|community|governance|board|volunteer|membership|get-involved|psf|our-work)(/|$|\?)"
)
REFERENCE_LINK = (
    r"(?i)/(wiki|encyclopedia|topic|topics|definition|dictionary|glossary|conditions?|diseases?|drugs?|symptoms?|treatments?|medications?|health|nutrition|health-news|medical|"
    r"vitamins|supplements|calculators?|compare|ratings|facts|biography|science|history|questions?|answers?)(/|$|\?)"
)
USER_PATH = r"(?i)/(users?|members?|profiles?|u|@[^/]+|people|creators?|artists?|sellers?|shops?/[^/]+|portfolio/[^/]+)(/|$)"
DONATE = r"(?i)/(donate|donations?|give|giving|support-us|membership|volunteer)(/|$|\?)"
DOC_TITLE = r"(?i)\b(tutorials?|documentation|docs|manual|handbook|api reference|cheat ?sheet|syntax|user guide|developer guide|getting started|quick ?start)\b|\breference\b(?! (guide|desk))"
DOC_SITE = r"(?i)\b(tutorials?|documentation|learn to code|programming (tutorials?|reference)|reference (guide|manual))\b"
FIRST_PERSON = r"(?i)\b(i'?m|i am) an? \w+|\bmy (blog|notes|writing|work|garden|newsletter|projects|essays|site)\b|\babout me\b|\bmy name is\b|\bi write about\b|\bhi,? i'?m\b"
STORE = (
    "onlinestore store wholesalestore departmentstore electronicsstore clothingstore furniturestore homegoodsstore grocerystore hardwarestore jewelrystore shoestore sportinggoodsstore "
    "toystore bookstore petstore outletstore bikestore computerstore florist gardenstore hobbyshop liquorstore mobilephonestore moviegoodsstore musicstore officeequipmentstore paintingstore"
)
SAAS = "softwareapplication webapplication mobileapplication softwaresourcecode"
LOCAL = (
    "localbusiness restaurant cafeorcoffeeshop barorpub bakery fastfoodrestaurant foodestablishment hotel lodgingbusiness bedandbreakfast motel resort dentist physician medicalclinic "
    "medicalbusiness hospital pharmacy hairsalon beautysalon dayspa healthclub gym sportsclub autorepair autodealer automotivebusiness gasstation carwash realestateagent legalservice "
    "attorney notary accountingservice financialservice insuranceagency bankorcreditunion homeandconstructionbusiness plumber electrician roofingcontractor hvacbusiness housepainter "
    "generalcontractor movingcompany locksmith travelagency touristattraction museum library childcare animalshelter veterinarycare petstore drycleaningorlaundry emergencyservice "
    "entertainmentbusiness nightclub moviehouse amusementpark artgallery shoppingcenter professionalservice employmentagency selfstorage storagefacility tireshop winery brewery distillery"
)
INSTITUTION = (
    "educationalorganization collegeoruniversity school highschool middleschool elementaryschool preschool governmentorganization governmentoffice governmentservice ngo nonprofit "
    "foundation researchorganization researchproject fundingagency library museum politicalparty consortium"
)
LISTING = "searchresultspage jobposting flight airport trip touristdestination realestatelisting apartment house singlefamilyresidence accommodation lodgingreservation event eventseries"
REVIEWS = "interactioncounter userreview review socialmediaposting discussionforumposting comment"
REFERENCE_PAGE = "medicalwebpage medicalcondition drug definedterm definedtermset qapage"
ORGANISATION = (
    "organization corporation newsmediaorganization educationalorganization governmentorganization ngo nonprofit onlinestore store localbusiness sportsorganization medicalorganization "
    "collegeoruniversity school"
)
NOT_CONTENT = ("home", "about", "contact", "legal", "login", "faq")
# ------------------------------------------------------------------------------------------------


def page_facts(pages: DataFrame) -> DataFrame:
    """One row of counts for each site, from its pages; pages that only a bot wall answered don't count."""
    c = F.col
    seen = pages.where("not wall")
    bare = F.array_distinct(F.concat("node_types", F.flatten(F.transform("json_ld", lambda x: x["types"]))))
    home, front = c("page_type") == "home", c("page_type").isin("home", "about")
    content = ~c("page_type").isin(*NOT_CONTENT)
    own = F.transform(F.filter("links", lambda x: x["internal"]), lambda x: F.coalesce(F.nullif(F.trim(x["text"]), F.lit("")), x["aria_label"], F.lit("")))
    counted = lambda pattern: F.aggregate(own, F.lit(0), lambda n, t: n + F.regexp_count(t, F.lit(pattern)))
    date = F.coalesce("published", "modified", F.get("times", F.lit(0)), F.nullif(F.regexp_extract(urls.path(c("url")), urls.DATE_IN_PATH, 0), F.lit("")))
    df = seen.select("*", bare.alias("kinds"), date.alias("date"))
    has = lambda types: F.arrays_overlap("kinds", F.array(*map(F.lit, types.split())))
    any_ = lambda e, name: F.coalesce(F.bool_or(e), F.lit(False)).alias(name)
    n = lambda e, name: F.count_if(e).alias(name)
    said = F.concat_ws(" ", "title", "description", F.substring("main_text", 1, 3000))
    return df.groupBy("site").agg(
        any_(c("generator").rlike(SHOP_PLATFORM), "platform"), any_(c("generator").rlike(DOC_GENERATOR), "doc_generator"), any_(c("generator").rlike(EDITORIAL_GENERATOR), "editorial"),
        any_(front & has(STORE), "store"), any_(has("newsmediaorganization"), "news_org"), any_(has(SAAS), "saas_org"), any_(front & has(LOCAL), "home_local"), any_(has(LOCAL), "any_local"),
        any_(front & has(INSTITUTION), "institution"), any_(has(LISTING), "listing"), any_(has(REVIEWS), "reviews"), n(has(REFERENCE_PAGE), "reference_pages"), any_(has(ORGANISATION), "org"),
        any_(has("person profilepage"), "person"), any_(has("profilepage") | (c("og_type") == "profile"), "profile"), any_(home & has("person profilepage"), "home_person"),
        F.array_distinct(F.flatten(F.collect_set("persons"))).alias("persons"), F.array_distinct(F.flatten(F.collect_set("authors"))).alias("authors"),
        n(content & (F.size("authors") > 0), "signed"), F.coalesce(F.sum(F.when(front, F.size("profile_links"))), F.lit(0)).alias("profiles"), n(content, "n_content"), n(content & c("date").isNotNull(), "dated"),
        n(content & (F.arrays_overlap("kinds", F.array(*map(F.lit, urls.TYPES_OF["article"]))) | (c("og_type") == "article")), "article_typed"),
        F.count_distinct(F.when(c("page_type") == "article", c("date"))).alias("article_dates"), any_("priced", "offer"), any_("postal", "address"), any_("shop_html", "shop"),
        n(content & c("title").rlike(DOC_TITLE), "doc_titled"), any_(home & F.concat_ws(" ", "title", "description").rlike(DOC_SITE), "says_docs"),
        F.coalesce(F.sum(F.when(front, F.regexp_count(said, F.lit(FIRST_PERSON)))), F.lit(0)).alias("first_person"),
        *[F.sum(counted(p)).alias(name) for name, p in (("cart_text", CART_TEXT), ("saas_text", SAAS_TEXT), ("local_text", LOCAL_TEXT), ("market_words", MARKET_TEXT), ("market_calls", MARKET_CALL))],
        F.coalesce(F.max(F.when(home, F.size(F.array_distinct(F.transform(F.filter("links", lambda x: x["internal"]), lambda x: urls.path(x["href"])))))), F.lit(0)).alias("home_links"),
        F.min_by("host", "ord").alias("host"),
    )


def path_facts(inventory: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts of a site's distinct paths by shape, and of its inventory with linked pages by page type."""
    c = F.col
    seen = pages.where("not wall")
    basis = virtual_inventory(inventory, seen).where("page_type <> 'asset'").select("site", "page_type", urls.path(c("url")).alias("path"), F.lit(True).alias("listed"), F.lit(None).cast("string").alias("href"))
    linked = seen.select("site", F.explode(F.filter("links", lambda x: x["internal"])).alias("l")).select("site", F.lit(None).cast("string").alias("page_type"), urls.path(c("l.href")).alias("path"), F.lit(False).alias("listed"), c("l.href").alias("href"))
    path = F.when(c("path") == "", "/").otherwise(c("path"))
    each = basis.unionByName(linked).withColumn("path", path).groupBy("site", "path").agg(
        F.count_if("listed").alias("listed"), F.max("href").alias("href"), *[F.count_if(c("page_type") == t).alias(t) for t in ("product", "category", "article", "documentation", "pricing")]
    )
    n = lambda e, name: F.count_if(e).alias(name)
    return each.groupBy("site").agg(
        F.sum("listed").alias("total"), F.sum(c("product") + c("category")).alias("catalogue"), F.sum("product").alias("product"), F.sum("article").alias("article"),
        F.sum("documentation").alias("documentation"), F.sum("pricing").alias("pricing"), F.sum(F.when(c("path").rlike("(?i)^/wiki/"), c("listed")).otherwise(0)).alias("wiki"),
        n(c("href").rlike(CART_LINK), "cart_links"), n(c("href").rlike(SAAS_LINK), "saas_links"), n(c("href").rlike(LOCAL_LINK), "local_links"), n(c("path").rlike(MARKET_LINK), "market_links"),
        n(c("path").rlike(USER_PATH), "user_paths"), n(c("path").rlike(INSTITUTION_LINK), "inst_links"), n(c("path").rlike(DONATE), "donate"), n(c("path").rlike(REFERENCE_LINK), "ref_links"),
    )


def _rules() -> tuple[list[tuple[str, Column, Column]], list[tuple[str, Column, Column]]]:
    """(kind, condition, weight) of evidence, and of what speaks against it: every rule that holds adds its weight."""
    c, lit = F.col, F.lit
    one = lambda *cases: F.coalesce(*[F.when(on, lit(float(w)) if not isinstance(w, Column) else w.cast("double")) for on, w in cases], lit(0.0))  # noqa: E731  the first that holds
    share = lambda n: F.when(c("total") > 0, n / c("total")).otherwise(lit(0.0))
    backed = lambda s: F.when(s >= 0.15, 1.0).when(s >= 0.05, 0.5).otherwise(0.25)
    org, many = c("org"), F.size("persons") >= 4
    single = (F.size("authors") == 1) & (c("signed") >= 2)
    docs, market = F.greatest(lit(0), c("documentation") - c("wiki")), c("market_words") + c("market_calls")
    cart, priced_plans = c("cart_links") > 0, c("pricing") > 0
    shop = cart | (c("cart_text") > 0) | c("store") | c("platform") | c("shop")
    itself = c("person") & ~org & ~many
    speaks = (c("first_person") > 0) & ~org & ~many & ~(cart | priced_plans)
    tld = F.element_at(F.split("host", r"\."), -1)
    public = tld.isin("edu", "gov", "mil") | c("host").rlike(r"\.(edu|gov|ac|gc)\.[a-z]{2}$")
    commerce, saas, inst = c("platform") | c("store") | cart, c("saas_org") | (priced_plans & (c("saas_text") >= 2)), c("institution") | public
    mostly = (c("n_content") >= 3) & (c("article_typed") >= 0.6 * c("n_content"))
    all_docs = (c("doc_titled") == c("n_content")) & (c("n_content") >= 4)
    yes = lit(True)
    capped = lambda most, x: F.least(lit(float(most)), x)
    return [
        ("ecommerce", c("platform"), lit(6.0)), ("ecommerce", c("store"), lit(5.0)), ("news_editorial", c("news_org"), lit(5.0)), ("saas_marketing", c("saas_org"), lit(4.0)),
        ("local_business", yes, one((c("home_local"), 5), (c("any_local") & (c("total") <= 60), 3))), ("marketplace", ~c("home_local") & c("any_local") & (c("total") > 60), lit(3.0)),
        ("institutional", c("institution"), lit(5.0)), ("institutional", yes, one((public, 4), (tld == "org", 1))), ("documentation", c("host").rlike(urls.DOC_HOST), lit(5.0)),
        ("documentation", c("doc_generator"), lit(5.0)), ("reference", c("host").rlike(urls.WIKI_HOST), lit(5.0)), ("marketplace", c("listing"), lit(4.0)), ("marketplace", c("reviews"), lit(1.5)),
        ("reference", yes, one((c("reference_pages") >= 2, 3), (c("reference_pages") == 1, 2))), ("marketplace", many, lit(2.0)),
        ("personal", itself, 3.0 + one((c("profile"), 2)) + one((c("home_person"), 2)) + one((single, 2)) + one((c("profiles") >= 2, 1)) + one(((c("dated") >= 2) | (c("article") >= 3), 1))),
        ("personal", ~itself & single & ~org & ~(cart | priced_plans), lit(2.0)), ("personal", speaks, capped(3, 1.5 + 0.5 * c("first_person")) + one((c("profiles") >= 2, 1))),
        ("ecommerce", c("catalogue") >= 3, F.least(F.when(shop, 5.0).otherwise(3.0), 8 * share(c("catalogue")) + one((c("product") >= 20, 1)))),
        ("documentation", docs >= 3, capped(4, 8 * share(docs)) + one((docs >= 10, 1))), ("news_editorial", c("article") >= 5, capped(3, 6 * share(c("article"))) + one((c("article_dates") >= 3, 0.5))),
        ("reference", c("wiki") >= 5, lit(4.0)), ("marketplace", c("market_links") >= 3, capped(3, c("market_links") / 4)), ("marketplace", c("user_paths") >= 3, capped(2, c("user_paths") / 5)),
        ("institutional", c("inst_links") >= 2, capped(2, c("inst_links") / 4)), ("reference", c("ref_links") >= 3, capped(2, c("ref_links") / 6)), ("saas_marketing", priced_plans, lit(2.0)),
        ("ecommerce", yes, one((cart, 4), (c("cart_text") >= 2, 1.5))), ("saas_marketing", c("saas_text") >= 2, 2.0 + one((c("saas_text") >= 6, 1))), ("saas_marketing", c("saas_links") >= 1, lit(1.0)),
        ("local_business", yes, one(((c("local_links") >= 2) & (c("local_text") >= 2), 3), ((c("local_links") >= 1) | (c("local_text") >= 3), 1))),
        ("marketplace", market >= 2, lit(2.0)), ("institutional", c("donate") > 0, lit(2.5)), ("documentation", c("says_docs"), lit(2.0)),
        ("ecommerce", c("offer"), one((shop, 2), (yes, 1))), ("news_editorial", (c("article_typed") >= 3) & (c("dated") >= 2), 2 * backed(share(c("article")))),
        ("documentation", (c("n_content") >= 3) & (2 * c("doc_titled") >= c("n_content")), 3 * F.greatest(backed(share(docs)), one((all_docs, 0.75)))),
        ("local_business", c("address") & (c("total") <= 15) & ~org, lit(1.5)), ("news_editorial", c("editorial") & (c("article") >= 3), lit(0.5)),
    ], [
        ("news_editorial", commerce, lit(-2.0)), ("saas_marketing", commerce, lit(-2.0)), ("personal", commerce, lit(-2.0)),
        ("news_editorial", saas, lit(-2.0)), ("documentation", saas & (share(docs) < 0.4), lit(-1.5)), ("personal", saas, lit(-2.0)),
        ("news_editorial", inst, lit(-2.0)), ("saas_marketing", inst, lit(-1.0)), ("personal", inst, lit(-3.0)), ("news_editorial", c("person") & ~org, lit(-3.0)), ("personal", c("news_org"), lit(-4.0)),
        ("saas_marketing", mostly & ~c("saas_org") & ~priced_plans, lit(-2.0)), ("institutional", (c("local_links") >= 2) | (c("local_text") >= 3), lit(-1.5)),
        ("local_business", (c("total") > 60) & ~c("home_local") & c("any_local"), lit(-2.0)), ("saas_marketing", (market >= 2) | c("listing"), lit(-1.5)), ("ecommerce", (market >= 2) | c("listing"), lit(-1.0)),
        ("personal", org, lit(-3.0)),
    ]


def decide(scores: Column, least: float = 3.0, lead: float = 1.0) -> Column:
    """struct<archetype, confidence> from an array<struct<score, rank, kind>>; ties go to the lower rank.

    A best score below least, or ahead of the second by less than lead, is unknown.
    """
    ordered = F.reverse(F.array_sort(F.transform(scores, lambda s: F.struct(s["score"], (-s["rank"]).alias("rank"), s["kind"]))))
    top, second = ordered[0], ordered[1]
    margin = top["score"] - F.greatest(second["score"], F.lit(0.0))
    sure = (top["score"] >= least) & (margin >= lead)
    confidence = 0.5 + 0.25 * F.least(top["score"], F.lit(12.0)) / 12 + 0.15 * F.least(margin, F.lit(6.0)) / 6
    confidence = F.bround(F.greatest(F.lit(0.55), F.least(F.lit(0.9), confidence)), 2)
    return F.struct(F.when(sure, top["kind"]).otherwise("unknown").alias("archetype"), F.when(sure, confidence).otherwise(0.0).alias("confidence"), top["score"].alias("best"))


def archetypes(
    pages: DataFrame, inventory: DataFrame, heads: DataFrame | None = None, robots: DataFrame | None = None, sitemaps: DataFrame | None = None, words: bool = True
) -> DataFrame:
    """site, archetype, confidence, scheme, canonical_host; one row for each site with a page.

    pages are typed() ones, inventory is (site, ord, url, page_type). Sites behind a bot wall are
    unknown; a few pages without any evidence are a brochure. heads (site, t), robots (site, body) and
    sitemaps (site, url) are hints that may be missing. words=False leaves the vocabulary out.
    """
    c = F.col
    pages = pages.withColumn("host", F.split_part(urls.host(c("url")), F.lit(":"), F.lit(1)))
    facts = page_facts(pages).join(path_facts(inventory, pages), "site", "left")
    zero = {k: F.lit(0.0) for k in KINDS}
    if sitemaps is not None:
        points = vocabulary.sitemap_hints(sitemaps).groupBy("site").pivot("kind", list(KINDS)).agg(F.first("points"))
        facts = facts.join(points.select("site", *[F.coalesce(c(k), F.lit(0.0)).alias(f"hint_{k}") for k in KINDS]), "site", "left")
        zero = {k: F.coalesce(f"hint_{k}", F.lit(0.0)) for k in KINDS}
    if words:
        seen = pages.where("not wall")
        basis = virtual_inventory(inventory, seen).where("page_type <> 'asset'").select("site", "r", F.coalesce(F.nullif(urls.path(c("url")), F.lit("")), F.lit("/")).alias("path"))
        said = vocabulary.leading(vocabulary.scores(seen, basis, heads, robots, sitemaps))
        facts = facts.join(said.select("site", c("kind").alias("said_kind"), "words"), "site", "left")
    facts = facts.fillna(0, [n for n, t in facts.dtypes if t in ("bigint", "int")])
    evidence, counter = _rules()
    added = lambda rules, totals: reduce(lambda t, r: t | {r[0]: t[r[0]] + F.when(F.coalesce(r[1], F.lit(False)), F.coalesce(r[2], F.lit(0.0))).otherwise(0.0)}, rules, totals)
    facts = facts.select("*", *[x.alias(f"for_{k}") for k, x in added(evidence, zero).items()])
    totals = {k: c(f"for_{k}") for k in KINDS}
    if words:  # words alone don't tell whether a site is an institution or sells software
        counts = {k: (c("said_kind") == k) & ((c(f"for_{k}") > 0) if k in ("institutional", "saas_marketing") else F.lit(True)) for k in KINDS}
        totals = {k: totals[k] + F.when(counts[k], c("words")).otherwise(0.0) for k in KINDS}
    totals = added(counter, totals)
    scored = facts.withColumn("scores", F.array(*[F.struct(totals[k].alias("score"), F.lit(i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]))
    scored = scored.withColumn("d", decide(c("scores")))
    documents = F.greatest(F.lit(0), c("documentation") - c("wiki"))
    small = (c("total") <= 8) & (c("home_links") > 0) & (c("d.best") < 2.5) & (c("product") == 0) & (c("article") < 3) & (documents == 0) & ~((c("total") <= 5) & (c("home_links") > 25))
    brochure = (c("d.archetype") == "unknown") & small
    decided = scored.select("site", F.when(brochure, "brochure").otherwise(c("d.archetype")).alias("archetype"), F.when(brochure, 0.6).otherwise(c("d.confidence")).alias("confidence"))
    sites = pages.groupBy("site").agg(F.min_by(urls.scheme(c("url")), "ord").alias("scheme"), F.min_by("host", "ord").alias("canonical_host"))
    out = sites.join(decided, "site", "left")
    return out.select("site", F.coalesce("archetype", F.lit("unknown")).alias("archetype"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "scheme", "canonical_host")
