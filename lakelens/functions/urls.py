"""URL functions as native columns. Null URLs give null parts, and false where a boolean is asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
TWO_PART_SUFFIXES = ("co.uk", "com.au", "co.in", "co.jp", "com.br")
NEVER_A_PAGE = r"(?i)(\.(xml|xml\.gz|gz|txt|json|pdf|css|js|mjs|zip|tar|rar|png|jpe?g|gif|webp|svg|ico|avif|woff2?|ttf|mp3|mp4|webm|mov)$)|(/sitemap[^/]*$)"
EXCLUDED_SEGMENTS = (
    "auth", "authentications", "oauth", "login", "signin", "signup", "logout", "sso", "callback",
    "legal", "legal-notice", "privacy", "terms", "cookies", "imprint", "impressum", "gdpr", "dmca", "eula", "mentions-legales", "conduct", "code-of-conduct", "coc",
    "assets", "brand", "media-kit", "press", "download", "downloads", "dl",
)
SESSION_VERB = r"(?i)/session(?:s)?/(?:new|create|edit|update|destroy|end|logout|renew|refresh)(?:/|$|\?)"
WIKI_ADMIN = (
    r"(?i)/wiki/(Template|Category|Help|Wikipedia|File|MediaWiki|Portal|Book|Draft|TimedText|Module|Special|User|User_talk|Talk|"
    r"Wikipedia_talk|Template_talk|Category_talk|File_talk|MediaWiki_talk|Portal_talk|Book_talk|Draft_talk|Module_talk)(:|%3A)"
)
REDIRECT_KEYS = ("return_to", "redirect_uri", "next", "go")
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik in io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw "
    "ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
VERSION_SEGMENT = r"(?i)^(v?\d+(\.\d+)*|stable|latest|current|dev|main|master|next|beta|alpha|rc\d*)$"
LOCALE_SEGMENT = r"(?i)^([a-z]{2,3}([_-][a-z]{2,4})?|in|us|uk|eu|au|ca|nz|asia|emea|apac)$"
URL_DATE = r"/((?:19|20)\d{2})/(\d{2})(?:/(\d{2}))?(?:/|$)"
#: (type, pattern of the path, pattern of the title or None), first match wins.
PAGE_RULES = (
    ("login", r"(?i)login|signin|sign-in|signup|sign-up|/account(s)?(/|$)|register|/auth(/|$)|password", True),
    ("legal", r"(?i)privacy|/terms|cookie|/legal|imprint|impressum|/tos(/|$)|accessibility-statement", True),
    ("faq", r"(?i)\bfaq(s)?\b|frequently-asked", True),
    ("pricing", r"(?i)/(pricing|plans|fees|compare-plans|pricing-plans|plans-and-pricing)(/|$|\?)|/pricing-|-(pricing|fees)(/|$)", r"(?i)^\s*pricing\b|pricing (&|and) plans|plans (&|and) pricing|pricing plans|compare plans"),
    (
        "documentation",
        r"(?i)/(docs?|documentation|api|apis|reference|manual|handbook|guides?|tutorials?|how-to|howto|kb|knowledge-?base|help-?center|developers?|dev|sdk|cli|getting-started|"
        r"quickstart|en/latest|en/stable|en/[0-9.]+|[0-9]+/library|specs?|specification|functions?|commands?|methods?|configuration|installation|troubleshooting|changelog|release-notes)(/|$)",
        None,
    ),
    ("contact", r"(?i)contact|/support(/|$)|get-in-touch|customer-service", True),
    ("about", r"(?i)/about|/company(/|$)|who-we-are|/team(/|$)|/mission(/|$)|/our-story|/leadership", True),
    ("product", r"(?i)/(products?|items?|shop|dp|itm|ip|listing|sku|pd|product-detail|prod)(/|$)|/p/[^/]*\d", None),
    ("category", r"(?i)/(collections?|categor(y|ies)|store|browse|catalog|catalogue|departments?|brands?|shop-by|all-products|new-arrivals)(/|$)|/cp/[^/]+/\d+", None),
    (
        "article",
        r"(?i)/(blog|blogs|news|articles?|posts?|stories|story|press|press-releases?|newsroom|magazine|editorial|opinion|insights?|journal|updates?|entertainment|politics|"
        r"business|sports?|world|tech|health|lifestyle|science|culture|travel)(/|$)",
        None,
    ),
)
ASSET = r"(?i)\.(png|jpe?g|gif|webp|svg|ico|bmp|avif|heic|css|js|mjs|json|xml|pdf|docx?|xlsx?|pptx?|csv|woff2?|ttf|eot|otf|mp3|mp4|webm|mov|avi|wav|ogg|zip|gz|tar|rar)$"
DATE_IN_PATH = r"/(19|20)\d{2}[/-](0?[1-9]|1[0-2])([/-]|$)"
DOC_HOST = r"(?i)^(docs?|documentation|developers?|kb|wiki|manual)\."
WIKI_HOST = r"(?i)^(wiki|[a-z]{2,3})\.wikipedia\.|^wiki\."
TYPES_OF = {
    "product": ("product", "offer", "aggregateoffer", "productgroup", "individualproduct", "productmodel", "vehicle"),
    "article": ("article", "blogposting", "newsarticle", "report", "scholarlyarticle", "liveblogposting", "opinionnewsarticle", "reviewnewsarticle", "analysisnewsarticle", "backgroundnewsarticle", "socialmediaposting", "medicalscholarlyarticle"),
    "documentation": ("techarticle", "apireference", "howto"),
    "faq": ("faqpage",),
    "category": ("collectionpage", "itemlist"),
}
# ------------------------------------------------------------------------------------------------

_REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Lower-case host with port and user, as written."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """Without parameters of the last segment; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, _REST, ""), r"^([^?#]*)", 1), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def registrable_domain(h: Column) -> Column:
    """The last two labels, or three after a known two-part suffix; short hosts as they are."""
    labels = F.split(F.split_part(F.lower(h), F.lit(":"), F.lit(1)), r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(two.isin(*TWO_PART_SUFFIXES), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def locale_of(tag: Column) -> Column:
    """The language of xx or xx-yy, if it is a known two-letter code."""
    code = F.lower(F.regexp_extract(tag, r"(?i)^([a-z]{2})(?:[-_][a-z]{2})?$", 1))
    return F.when(code.isin(*LANGUAGES), code)


def url_locale(url: Column) -> Column:
    return locale_of(F.coalesce(F.get(segments(url), F.lit(0)), F.lit("")))


def _looks_like_url(value: Column) -> Column:
    return F.lower(value).rlike(r"^(https?://|/|%2f)")


def is_page_url(url: Column) -> Column:
    """Whether a URL can be a content page: no asset, sitemap, account, legal or redirect URL."""
    p = F.when(path(url) == "", "/").otherwise(path(url))
    family = r"(^|/)(" + "|".join(EXCLUDED_SEGMENTS) + r")(/|$)"
    pairs = F.split(query(url), "&")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    redirect = F.exists(
        pairs, lambda x: F.lower(decoded(F.split_part(x, F.lit("="), F.lit(1)))).isin(*REDIRECT_KEYS) & _looks_like_url(decoded(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)))
    )
    bad = p.rlike(NEVER_A_PAGE) | F.lower(p).rlike(family) | p.rlike(SESSION_VERB) | p.rlike(WIKI_ADMIN) | redirect
    return F.coalesce(~bad, F.lit(False))


def page_type(url: Column, title: Column | None = None, types: Column | None = None) -> Column:
    """One of the page types; rules go in order, by structured types, then by path and title."""
    title = F.coalesce(title if title is not None else F.lit(None).cast("string"), F.lit(""))
    p, h = path(url), host(url)
    out = F.when(url.isNull(), F.lit(None).cast("string")).when((p == "") | (p == "/"), "home").when(p.rlike(ASSET), "asset")
    if types is not None:
        for kind, names in TYPES_OF.items():
            out = out.when(F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, names))), F.lit(False)), kind)
    for kind, pattern, in_title in PAGE_RULES:
        out = out.when(p.rlike(pattern), kind)
        if in_title:
            out = out.when(title.rlike(pattern if in_title is True else in_title), kind)
    return out.when(p.rlike(DATE_IN_PATH), "article").when(p.rlike("(?i)/wiki/") | h.rlike(WIKI_HOST) | h.rlike(DOC_HOST), "documentation").otherwise("other")


def variant_kind(a: Column, b: Column) -> Column:
    """'versioned' or 'localised' if two URLs differ in one such path segment, else null."""
    x, y = segments(a), segments(b)
    local = lambda s: F.coalesce(s.rlike(LOCALE_SEGMENT), F.lit(False))
    root = ((F.size(x) == 0) & (F.size(y) == 1) & local(F.get(y, F.lit(0)))) | ((F.size(y) == 0) & (F.size(x) == 1) & local(F.get(x, F.lit(0))))
    other = F.filter(F.arrays_zip(x.alias("p"), y.alias("q")), lambda s: s["p"] != s["q"])
    one = F.get(other, F.lit(0))
    single = (F.size(x) == F.size(y)) & (F.size(x) >= 1) & (F.size(other) == 1)
    return (
        F.when(root, "localised")
        .when(single & one["p"].rlike(VERSION_SEGMENT) & one["q"].rlike(VERSION_SEGMENT), "versioned")
        .when(single & local(one["p"]) & local(one["q"]), "localised")
    )


def url_date(url: Column) -> Column:
    found = lambda i: F.regexp_extract(path(url), URL_DATE, i)
    return F.when(path(url).rlike(URL_DATE), F.concat(found(1), F.lit("-"), found(2), F.when(found(3) != "", F.concat(F.lit("-"), found(3))).otherwise("")))
