"""Scores of kinds of sites by the words they use.

Every term counts in a site's own description, its visible text, its raw markup, the paths of its
robots.txt and those of its inventory, up to a cap in each, by the term's weight and the source's.
Names of sitemaps add to a kind. A kind without any of its core terms has no score. Pages are counted
one by one and summed by site, so that no site's text is put together.

A text is searched only for the terms that its words allow: every term has words, one of which is
part of a run of letters in any text that it matches. Runs are looked up once, so a text costs one
pass instead of one for each term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# --- fixed values -------------------------------------------------------------------------------
TERMS = {
    "ecommerce": (
        (r"add[ -]to[ -](cart|bag|basket)|addtocart", 3), (r"\bcart\b|\bbasket\b", 1), (r"checkout", 1), (r"free shipping|free delivery", 2),
        (r"shop now|shop all|buy now", 2), (r"wish ?list", 1), (r"best ?sellers|new arrivals|top rated", 2), (r"shop by (category|brand|department)", 3),
        (r"in stock|out of stock", 2), (r"\bsku\b", 1), (r"coupons?|promo code", 1), (r"free returns|returns? policy", 1), (r"track (my |your )?order|order tracking", 2),
        (r"\bshopping\b", 1), (r"\bdeals?\b|\bsale\b|clearance", 1),
        (r"clothing|apparel|beauty|jewel(le)?ry|electronics|furniture|home (&|and) garden|appliances|footwear|accessories", 1),
    ),
    "marketplace": (
        (r"compare (prices|flights|hotels|rates|rentals)", 3), (r"\bflights?\b|airfare", 2), (r"\bhotels?\b", 2), (r"car (rental|hire)", 2), (r"\blistings?\b", 2),
        (r"homes? for sale|houses? for sale", 3), (r"for rent", 2), (r"apartments?", 1), (r"\bjobs?\b|job search|job listings", 1), (r"salar(y|ies)", 2),
        (r"post (a|an|your) (job|ad|listing)", 3), (r"classifieds", 3), (r"book now|book a (room|flight|table)", 1),
        (r"find (a |the |your )?(job|home|hotel|flight|deal|apartment|rental)", 3), (r"\bsellers?\b|\bbuyers?\b|\bhosts?\b", 1), (r"\brentals?\b|vacation rentals?", 2),
        (r"cruises?", 2), (r"marketplace", 2), (r"real estate|realtor|\bmls\b", 2), (r"employers?|recruiters?|candidates?", 1),
    ),
    "saas_marketing": (
        (r"free trial|try (it )?free|start (your )?free", 3), (r"(request|book|get|schedule|watch) a demo", 3), (r"\bpricing\b", 2), (r"\bplans\b", 1),
        (r"sign ?up|create (an|your) account", 1), (r"get started", 1), (r"\bplatform\b", 1), (r"integrations?", 2), (r"\bfeatures\b", 1), (r"enterprise", 1),
        (r"\bcrm\b", 2), (r"workflows?", 1), (r"\bsoftware\b", 1), (r"start for free|free forever|free plan", 3), (r"all-in-one", 1), (r"no credit card", 3),
        (r"design tool|website builder|email marketing|analytics|automation|collaboration|productivity|dashboard", 2), (r"talk to sales|contact sales", 2),
        (r"\bsaas\b|cloud-based", 2), (r"customers|trusted by", 1),
    ),
    "news_editorial": (
        (r"breaking news", 3), (r"latest news|top stories|top news", 2), (r"headlines", 2), (r"\bopinion\b|op-ed|editorial", 1), (r"newsletter", 1),
        (r"subscribe|subscription", 1), (r"journalists?|reporters?|correspondents?|columnists?", 2), (r"live updates|live blog", 3), (r"\bpolitics\b", 1),
        (r"world news|local news|national news", 2), (r"\bsports\b|entertainment|celebrity|showbiz", 0.5), (r"\d+ min read", 2), (r"newsroom", 2), (r"\bnews\b", 1),
        (r"published|updated (on|at)", 0.5), (r"exclusive|investigation", 1), (r"magazine|journal", 1),
    ),
    "documentation": (
        (r"documentation", 3), (r"tutorials?", 3), (r"api reference", 3), (r"\breference\b", 1), (r"getting started", 2), (r"install(ation)?", 1), (r"\bguides?\b", 1),
        (r"examples?", 1), (r"\bsyntax\b", 2), (r"changelog|release notes", 2), (r"cheat ?sheet", 2), (r"\bapi\b", 1), (r"\bsdk\b", 2), (r"\bcli\b", 1),
        (r"source code|open source|github", 1), (r"functions?|methods?|classes|parameters?|arguments?", 0.5), (r"learn to code|programming|coding", 2),
        (r"quick ?start", 2), (r"\bdocs\b", 3), (r"how[- ]to", 1), (r"exercises?|quiz(zes)?|certificates?", 1),
    ),
    "reference": (
        (r"encyclop(a)?edia", 3), (r"definitions?|dictionary|glossary|thesaurus", 2), (r"symptoms", 2), (r"treatments?", 2), (r"\bcauses\b", 1), (r"diagnosis", 2),
        (r"medically reviewed|fact[- ]checked|peer[- ]reviewed", 3), (r"health conditions|conditions a-z|drugs a-z", 2), (r"\bwiki\b", 2), (r"\bfacts\b", 1),
        (r"what is", 1), (r"biograph(y|ies)", 2), (r"drug interactions|side effects|dosage", 2), (r"forecast|radar", 1), (r"overview", 0.5), (r"topics?", 0.5),
        (r"\barticles\b", 0.5), (r"trusted (source|information)|expert", 1),
    ),
    "institutional": (
        (r"universit(y|ies)|college", 3), (r"admissions?", 3), (r"\bstudents?\b", 1), (r"faculty", 2), (r"\bcampus\b", 2), (r"\bresearch\b", 1),
        (r"government|federal|\bagency\b|ministry", 2), (r"official (website|site)", 2), (r"department of", 2), (r"foundation", 2), (r"non[- ]?profit|charity", 3),
        (r"\bdonate\b|donation", 2), (r"\bmission\b", 1), (r"alumni", 2), (r"academic", 2), (r"\bpolicy\b|public policy", 1), (r"\.gov\b", 2),
        (r"initiative|program(me)?s?", 0.5), (r"\bcommunity\b", 0.5), (r"grants?|funding", 1), (r"press release|newsroom", 0.5),
    ),
    "local_business": (
        (r"\bmenu\b", 2), (r"order online|order now|order ahead", 3), (r"\blocations?\b", 1), (r"find a (store|location|restaurant)|store locator", 3),
        (r"\bhours\b|opening hours|open now", 1), (r"directions", 2), (r"reservations?|book a table", 2), (r"delivery", 1), (r"pick ?up|curbside", 1),
        (r"near (you|me)|nearby", 2), (r"restaurants?", 2), (r"catering", 2), (r"franchise", 1), (r"pizza|burgers?|tacos?|coffee|bakery|grill|kitchen", 1),
        (r"dine[- ]in|drive[- ]thru|takeout|take-away", 2), (r"\b(salon|spa|clinic|dental|plumbing|roofing|auto repair)\b", 2), (r"visit us|come visit", 1),
    ),
}
CORE = {
    "ecommerce": r"add[ -]to[ -](cart|bag|basket)|addtocart|\bcart\b|checkout|free shipping|shop now|buy now|in stock|\bsku\b",
    "marketplace": r"\blistings?\b|\bjobs?\b|\bhotels?\b|\bflights?\b|for rent|for sale|\brentals?\b|classifieds|marketplace|apartments?|car (rental|hire)|salar(y|ies)",
    "saas_marketing": r"free trial|a demo|\bpricing\b|sign ?up|get started|\bplans\b|start for free|no credit card|integrations?",
    "news_editorial": r"\bnews\b|headlines|journalists?|reporters?|editor|subscribe|newsletter|breaking|live updates",
    "documentation": r"documentation|tutorials?|\bapi\b|\breference\b|\bdocs\b|install|getting started|\bsdk\b|\bcli\b",
    "reference": r"encyclop|definition|dictionary|glossary|symptoms|treatment|\bwiki\b|medically reviewed|\bfacts\b|biograph",
    "institutional": r"universit|college|government|federal|\bagency\b|foundation|non[- ]?profit|charity|\bdonate\b|official|\.gov\b|department of|admissions?",
    "local_business": r"order (online|now|ahead)|find a (store|location|restaurant)|store locator|opening hours|\bhours\b|directions|reservations?|book a table|near (you|me)|dine[- ]in|drive[- ]thru|takeout|curbside|catering",
}
SITEMAP_NAMES = (
    ("ecommerce", r"(?i)product|collection|categor|catalog|brand|store"), ("news_editorial", r"(?i)news|article|post|blog|stor(y|ies)|editorial"),
    ("documentation", r"(?i)docs?|documentation|tutorial|reference|guide"), ("marketplace", r"(?i)job|listing|hotel|flight|rental|home|propert|classified"),
    ("reference", r"(?i)wiki|condition|drug|topic|definition|encyclop"), ("local_business", r"(?i)location|store-?locator|restaurant|menu"),
)
#: (weight, cap) of each source; a sitemap's name.
SOURCES = {"described": (4.0, 3), "visible": (1.0, 5), "raw": (0.3, 10), "robots": (2.0, 5), "paths": (0.5, 10)}
SITEMAP, VISIBLE, MOST_PATHS = 3.0, 20_000, 500
# ------------------------------------------------------------------------------------------------
_RULES = [(i, kind, pattern, float(weight)) for i, (kind, pattern, weight) in enumerate((k, p, w) for k, terms in TERMS.items() for p, w in terms)]


_PATTERNS = [p for _, _, p, _ in _RULES] + list(CORE.values())
_KINDS = [kind for _, kind, _, _ in _RULES] + list(CORE)
MOST_KNOWN = 200_000


def needed(pattern: str) -> set[str]:
    """Runs of lower-case letters, one of which is in every text that the pattern matches in whatever case."""

    def of(parsed) -> set[str] | None:
        found, run = [], ""
        for op, value in [*parsed, (None, None)]:
            if op is _parser.LITERAL and chr(value).isascii() and chr(value).isalpha():
                run += chr(value).lower()
                continue
            found, run = [*found, {run}] if run else found, ""
            if op is _parser.SUBPATTERN:
                inner = of(value[-1])
            elif op is _parser.BRANCH:
                each = [of(x) for x in value[1]]
                inner = None if None in each else set().union(*each)
            else:
                inner = of(value[2]) if op is _parser.MAX_REPEAT and value[0] > 0 else None
            found += [inner] if inner else []
        return max(found, key=lambda runs: min(map(len, runs)), default=None)

    runs = of(_parser.parse(pattern))
    if not runs:
        raise ValueError(f"a term needs a letter: {pattern}")
    return runs


def _places() -> dict[str, set[int]]:
    out: dict[str, set[int]] = {}
    for k, pattern in enumerate(_PATTERNS):
        for run in needed(pattern):
            out.setdefault(run, set()).add(k)
    return out


_PLACES = _places()
_LENGTHS = sorted({len(run) for run in _PLACES})


def _allowed_by(word: str) -> frozenset[int]:
    """Places of the patterns that have one of their runs in a word."""
    parts = {word[i : i + n] for n in _LENGTHS for i in range(len(word) - n + 1)} & _PLACES.keys()
    return frozenset().union(*[_PLACES[x] for x in parts])


@F.pandas_udf(ArrayType(IntegerType()))
def _allowed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Places of the patterns that each text may match; the others can't."""
    letters, known = re.compile("[a-z]+").findall, {}

    def one(text: str | None) -> list[int]:
        out: set[int] = set()
        for word in set(letters((text or "").lower())):
            if (hit := known.get(word)) is None:
                if len(known) >= MOST_KNOWN:
                    known.clear()
                hit = known[word] = _allowed_by(word)
            if hit:
                out |= hit
        return sorted(out)

    for t in texts:
        yield t.map(one)


def _counted(texts: DataFrame) -> DataFrame:
    """site, source, i, n of texts (site, source, t): how often each of _PATTERNS comes in each source of a site."""
    patterns = F.array(*[F.lit("(?i)" + p) for p in _PATTERNS])
    n = F.transform("allowed", lambda k: F.struct(k.alias("i"), F.regexp_count("t", F.get(patterns, k)).alias("n")))
    found = texts.select("site", "source", "t", _allowed("t").alias("allowed")).where(F.size("allowed") > 0)
    return found.select("site", "source", F.explode(n).alias("x")).where("x.n > 0").groupBy("site", "source", "x.i").agg(F.sum("x.n").alias("n"))


def _path_words(path: Column) -> Column:
    return F.regexp_replace(path, "[/_.-]+", " ")


def scores(pages: DataFrame, paths: DataFrame, heads: DataFrame | None = None, robots: DataFrame | None = None, sitemaps: DataFrame | None = None) -> DataFrame:
    """site, kind, score, terms (the four that give most): rows with a score alone.

    pages are extracted ones, paths is (site, r, path) of the inventory in order, heads (site, t) raw
    markup, robots (site, body), sitemaps (site, url). Missing tables add nothing.
    """
    c = F.col
    described = pages.select("site", F.lit("described").alias("source"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))).alias("t"))
    texts = described.unionByName(pages.select("site", F.lit("visible").alias("source"), F.substring(F.coalesce("main_text", F.lit("")), 1, VISIBLE).alias("t")))
    first = paths.where(c("r") <= MOST_PATHS).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("r", _path_words(c("path")).alias("w")))).alias("x"))
    texts = texts.unionByName(first.select("site", F.lit("paths").alias("source"), F.array_join(F.transform("x", lambda y: y["w"]), " ").alias("t")))
    if heads is not None:
        texts = texts.unionByName(heads.select("site", F.lit("raw").alias("source"), F.coalesce("t", F.lit("")).alias("t")))
    if robots is not None:
        rules = F.array_join(F.regexp_extract_all("body", F.lit(r"(?im)^(?:dis)?allow:[^\S\n]*(\S+)"), F.lit(1)), " ")
        texts = texts.unionByName(robots.select("site", F.lit("robots").alias("source"), F.regexp_replace(F.coalesce(rules, F.lit("")), "[/*$?=&_.-]+", " ").alias("t")))
    found = _counted(texts)
    table = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    weight, cap = table({k: w for k, (w, _) in SOURCES.items()}), table({k: n for k, (_, n) in SOURCES.items()})
    kind, own, name = F.get(F.array(*map(F.lit, _KINDS)), c("i")), table({i: w for i, _, _, w in _RULES}), table({i: p[:18] for i, _, p, _ in _RULES})
    gain = F.least(c("n"), F.try_element_at(cap, c("source"))) * F.try_element_at(own, c("i")) * F.try_element_at(weight, c("source"))
    is_core = (c("i") >= len(_RULES)) & (c("source") != "paths")
    told = found.select("site", kind.alias("kind"), F.try_element_at(name, c("i")).alias("term"), gain.alias("gain"), is_core.alias("core"))  # rows of core terms have no term
    if sitemaps is not None:
        last = F.element_at(F.split("url", "/"), -1)
        hints = F.array_compact(F.array(*[F.when(last.rlike(p), k) for k, p in SITEMAP_NAMES]))
        told = told.unionByName(sitemaps.select("site", F.explode(hints).alias("kind"), F.concat(F.lit("sitemap:"), F.substring(last, 1, 20)).alias("term"), F.lit(SITEMAP).alias("gain"), F.lit(False).alias("core")))
    per = told.groupBy("site", "kind", "term").agg(F.sum("gain").alias("gain"), F.bool_or("core").alias("core"))  # at most some hundred terms a site and kind
    ordered = F.slice(F.array_sort(F.collect_list(F.when(c("term").isNotNull(), F.struct((-c("gain")).alias("g"), "term")))), 1, 4)
    terms = F.transform(ordered, lambda x: F.concat(x["term"], F.lit("x"), F.bround(-x["g"]).cast("int").cast("string")))
    both = per.groupBy("site", "kind").agg(F.bround(F.sum("gain"), 1).alias("score"), terms.alias("terms"), F.bool_or("core").alias("core"))
    return both.where("core and score is not null").drop("core")


def leading(scored: DataFrame) -> DataFrame:
    """site, kind, score, words (what it adds to its kind): the kind of most score, if it is high enough and well ahead."""
    order = list(TERMS)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(order) for x in (k, i)]), F.col("kind"))
    tops = scored.groupBy("site").agg(F.max(F.struct("score", (-rank).alias("rank"), "kind")).alias("top"), F.sum("score").alias("total"), F.array_sort(F.collect_list("score")).alias("all"))
    second = F.when(F.size("all") > 1, F.get("all", F.size("all") - 2)).otherwise(0.0)
    clear = (F.col("top.score") >= 12) & (F.col("top.score") >= 1.5 * F.greatest(second, F.lit(1.0)))
    return tops.where(clear).select("site", "top.kind", "top.score", F.least(F.lit(3.0), 1 + (F.col("top.score") - 8) / 10).alias("words"))


def sitemap_hints(sitemaps: DataFrame) -> DataFrame:
    """site, kind, points: up to 2, one for each name of a sitemap that suggests a kind, digits apart."""
    last = F.element_at(F.split("url", "/"), -1)
    hints = F.array_compact(F.array(*[F.when(last.rlike(p), k) for k, p in SITEMAP_NAMES]))
    bare = F.regexp_replace(F.lower(last), r"[\d_.-]+", "")
    return sitemaps.select("site", F.explode(hints).alias("kind"), bare.alias("bare")).groupBy("site", "kind").agg(F.least(F.lit(2.0), F.count_distinct("bare").cast("double")).alias("points"))
