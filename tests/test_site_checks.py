"""Checks that need a rendering or the kind of site, on small literal inputs."""

import json

from lakelens.operators import checks, gated, html, rendered


def pages(spark, rows):
    raw = spark.createDataFrame([(i, s, i, u, h) for i, (s, u, h) in enumerate(rows)], "page_id long, site string, ord int, url string, html string")
    return checks.typed(html.extract_pages(raw))


def ld(*entities):
    return "".join(f'<script type="application/ld+json">{json.dumps(e)}</script>' for e in entities)


def states(df):
    return {(r.site, r.url, r.check_id): (r.state, r.severity) for r in df.collect()}


def test_rendered(spark):
    long = "word " * 120
    p = pages(spark, [("a", "https://a/", "<body>x"), ("b", "https://b/", "<body>x"), ("c", "https://c/", f"<body><h1>t</h1>{long}"), ("d", "https://d/q", "<body>x"), ("e", "https://e/", f"<body>x<noscript>{long}</noscript>")])
    rows = [
        ("b", 0, "https://b/", "ok", 300, 1, [(20.0, 30.0, True), (5.0, 5.0, False), (None, 30.0, True)], [("none", 80.0)], True, True, [(4.0, 16.0, False), (4.0, 20.0, False), (2.0, 20.0, True)]),
        ("b", 1, "https://b/", "ok", 0, 0, [], [], False, False, []),
        ("c", 0, "https://c/", "ok", 400, 1, [(24.0, 24.0, True)], [("none", 80.0)], False, False, [(7.0, 16.0, False)]),
        ("f", 0, "https://f/", "failed", None, None, None, None, None, None, None),
    ]
    r = spark.createDataFrame(rows, rendered.RENDERED)
    s = states(rendered.home_envelopes(p, r))
    assert s["a", "https://a/", "CHK-D-003"] == ("present", "high") and s["a", "https://a/", "CHK-E-019"][0] == "suppressed"
    assert s["b", "https://b/", "CHK-D-003"] == ("present", "critical") and s["c", "https://c/", "CHK-D-003"] == ("present", "medium")
    assert s["c", "https://c/", "CHK-E-019"][0] == "absent" and s["d", None, "CHK-D-003"][0] == "not_determinable" and s["e", "https://e/", "CHK-D-003"][0] == "absent"
    s = rendered.page_envelopes(p, r).collect()
    assert {(x.url, x.check_id, x.state, x.violations) for x in s if x.site in "bc"} == {("https://b/", "CHK-E-014", "present", 2), ("https://b/", "CHK-E-015", "present", 1), ("https://c/", "CHK-E-014", "absent", 0)}
    s = [(x.url, x.check_id, x.state, x.violations) for x in rendered.rendering_envelopes(r).orderBy("site", "seq").collect()]
    assert s[:2] == [("https://b/", "CHK-E-016", "present", 1), ("https://b/", "CHK-E-018", "present", 1)]
    assert [x[2] for x in s[2:]] == ["absent", "absent", "absent", "absent", "not_determinable", "not_determinable"]


def test_identity(spark):
    org = ld({"@type": "Organization", "name": "Acme Inc.", "url": "https://a", "sameAs": ["https://x.com/acme"]})
    p = pages(spark, [
        ("a", "https://a/", f"<title>Acme | Home</title>{org}<body><h1>Acme is a company</h1><a href='mailto:x@a.com'>m</a><a href=/about>u</a><footer>© 2024 Acme</footer>"),
        ("a", "https://a/about", "<body>x<footer>© Acme Ltd</footer>"),
        ("b", "http://b/", "<body><h1>Hello</h1><footer>© Bolt</footer><a href=/about>u</a>"), ("b", "http://b/about", "<body>y<footer>© Nuts</footer>"),
        ("c", "https://c/", "<body><a href='https://github.com/some'>g</a>"), ("d", "https://d/zzz", "<body>x"),
    ])
    sites = spark.createDataFrame([("a", "ecommerce", "https", "www.acme.com"), ("b", "saas_marketing", "http", "b.io"), ("c", "personal", "https", "c"), ("d", "unknown", "https", "d")], "site string, archetype string, scheme string, canonical_host string")
    s = {(r.site, r.check_id[4:]): (r.state, r.defect_key) for r in gated.identity_envelopes(p, sites).collect()}
    assert [s["a", k][0] for k in ("D-006", "D-007", "D-025", "D-027", "E-024")] == ["absent"] * 5
    assert [s["b", k][0] for k in ("D-006", "D-007", "D-025", "D-027", "E-024")] == ["present"] * 5 and s["b", "E-024"][1] == "contact+https"
    assert [s["c", k][0] for k in ("D-006", "D-007", "D-025", "D-027", "E-024")] == ["not_applicable", "not_applicable", "not_applicable", "not_determinable", "not_applicable"]
    assert [s["d", k][0] for k in ("D-006", "D-007", "D-025", "D-027", "E-024")] == ["not_applicable", "not_applicable", "not_determinable", "not_determinable", "not_applicable"]


def test_profiles(spark):
    from pyspark.sql import functions as F

    cases = {
        "https://github.com/someone": True, "https://github.com/pricing": False, "https://github.com/a/b": False, "https://x.com/i?q=1": False, "https://www.linkedin.com/in/a": True,
        "https://linkedin.com/in/": False, "https://en.wikipedia.org/wiki/A": True, "https://youtube.com/@a": True, "https://youtube.com/watch?v=1": False, "https://example.com/a": False,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, u string")
    assert [r[1] for r in rows.select("i", gated.is_profile(F.col("u"))).orderBy("i").collect()] == list(cases.values())


def test_trade_markup_and_dates(spark):
    good = ld({"@type": "Product", "name": "P", "offers": [{"price": 3, "priceCurrency": "EUR"}]})
    bad = ld({"@type": "Product", "name": "P", "offers": {"price": 3}})
    news = ld({"@type": "NewsArticle", "headline": "H", "datePublished": "2024-01-01", "author": [{"name": "Ann Ray"}, "Bob"]})
    feed = "<head><link rel=alternate type='application/rss+xml' href='/f'></head>"
    p = pages(spark, [
        ("a", "https://a/product/1", good), ("b", "https://b/product/1", good), ("b", "https://b/product/2", bad), ("n", "https://n/2024/05/x", feed + news),
        ("p", "https://p/", feed + ld({"@type": "Person", "name": "Ann Ray"})), ("p", "https://p/2024/05/x", news), ("q", "https://q/blog/x", "<body>no"),
        ("r", "https://r/", "<title>Open data</title>"), ("s", "https://s/jobs/1", ld({"@type": "JobPosting", "title": "T", "datePosted": "d", "hiringOrganization": {"name": "x"}})),
        ("t", "https://t/pricing", ld({"@type": "SoftwareApplication", "name": "T", "operatingSystem": "any"})),
        ("u", "https://u/article/2023/x", "<body><p>Announced, released and updated yesterday."),
    ])
    kinds = {"a": "ecommerce", "b": "ecommerce", "n": "news_editorial", "p": "personal", "q": "hobby", "r": "reference", "s": "marketplace", "t": "saas_marketing"}
    sites = spark.createDataFrame([(k, v, "https", k) for k, v in kinds.items()], "site string, archetype string, scheme string, canonical_host string")
    s = {(r.site, r.check_id[-3:]): r.state for r in gated.trade_envelopes(p, sites).collect()}
    want = {("a", "029"): "absent", ("b", "029"): "present", ("n", "032"): "absent", ("p", "033"): "absent", ("q", "033"): "present", ("r", "034"): "present", ("s", "031"): "absent", ("t", "030"): "absent"}
    assert {k: s[k] for k in want} == want and all(v == "not_applicable" for k, v in s.items() if k not in want)
    s = {r.url: r.state for r in gated.date_envelopes(p).collect()}
    assert s["https://u/article/2023/x"] == "present" and "https://q/blog/x" not in s


def test_archetypes(spark):
    from pyspark.sql import functions as F

    from lakelens.operators import archetype

    wall = "<title>Just a moment</title><body>x"
    p = pages(spark, [
        ("shop", "https://shop.com/", "<meta name=generator content=Shopify><body><a href=/cart>Cart</a><a href=/product/1>p</a>"),
        ("docs", "https://docs.x.com/", "<title>Documentation</title><body>x"),
        ("uni", "https://x.edu/", ld({"@type": "CollegeOrUniversity", "name": "U"}) + "<a href=/donate>Give</a>"),
        ("me", "https://ann.net/", ld({"@type": "Person", "name": "Ann"}) + "<h1>Hi, I'm a writer</h1><a href=/about>about me</a>"),
        ("small", "https://small.com/", "<body>x<a href=/zzz>z</a>"), ("small", "https://small.com/zzz", "<body>y"), ("blocked", "https://blocked.com/", wall),
    ])
    inventory = p.select("site", "ord", "url", "page_type")
    got = {r.site: (r.archetype, r.confidence) for r in archetype.archetypes(p, inventory, words=False).collect()}
    assert {k: v[0] for k, v in got.items()} == {"shop": "ecommerce", "docs": "documentation", "uni": "institutional", "me": "personal", "small": "brochure", "blocked": "unknown"}
    assert got["docs"][1] == 0.8 and got["small"][1] == 0.6  # 7 points: 0.5 + 0.25 * 7 / 12 + 0.15 = 0.796
    scores = spark.createDataFrame([([(3.0, 0, "a"), (3.0, 1, "b")],), ([(4.0, 0, "a"), (3.0, 1, "b")],), ([(2.0, 0, "a"), (-3.0, 1, "b")],)], "s array<struct<score:double,rank:int,kind:string>>")
    assert [r[0].archetype for r in scores.select(archetype.decide(F.col("s"))).collect()] == ["unknown", "a", "unknown"]


def test_vocabulary_searches_a_text_only_for_terms_of_its_words(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from lakelens.operators import vocabulary

    draw, seen, words = random.Random(7), set(), re.compile("[a-z]+")
    for i in range(12_000):  # words of a pattern in its order, mostly, glued in several ways
        parts = [w for w in words.findall(vocabulary._PATTERNS[i % len(vocabulary._PATTERNS)].replace(r"\b", " ").replace(r"\d", "7")) if draw.random() < 0.4]
        t = "7 " * draw.randint(0, 1) + draw.choice([" ", "", "-", " x "]).join(w.upper() if draw.random() < 0.2 else w for w in parts) + draw.choice(["", "s", "İ"])
        allowed = set().union(*map(vocabulary._allowed_by, words.findall(t.lower())))
        hits = {k for k, p in enumerate(vocabulary._PATTERNS) if re.search(p, t, re.I | re.A)}
        assert hits <= allowed, t
        seen |= hits
    assert len(seen) > 0.9 * len(vocabulary._PATTERNS)
    texts = spark.createDataFrame([("a", "raw", "Add to cart, add-to-bag. ADDTOCART " * 3), ("a", "raw", "ouleou des " * 50), ("b", "raw", "cartons")], "site string, source string, t string")
    found = vocabulary._counted(texts)
    name = F.get(F.array(*map(F.lit, vocabulary._PATTERNS)), F.col("i"))
    got = {(r.site, r.p): r.n for r in found.where(F.col("i") < len(vocabulary._RULES)).select("site", name.alias("p"), "n").collect()}
    assert got == {("a", r"add[ -]to[ -](cart|bag|basket)|addtocart"): 9, ("a", r"\bcart\b|\bbasket\b"): 3}
    p, paths = pages(spark, [("a", "https://a/", "<p>Add to cart")]), spark.createDataFrame([("a", 1, "/")], "site string, r int, path string")
    plan = vocabulary.scores(p, paths)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("regexp_extract_all") == 1  # before, each text was searched for each term in several copies of the plan


def test_vocabulary(spark):
    """Words alone decide for a shop, not for an institution; a kind needs a core term."""
    import re

    from pyspark.sql import functions as F

    from lakelens.operators import archetype, vocabulary

    shop = "add to cart free shipping shop now in stock wish list best sellers " * 3
    p = pages(spark, [("shop", "https://s.com/aaa", f"<title>Checkout and cart</title><body>{shop}"), ("uni", "https://u.com/aaa", f"<body>{'university admissions campus faculty alumni donate foundation ' * 4}"), ("food", "https://f.com/aaa", f"<body>{'pizza kitchen coffee bakery menu ' * 9}")])
    paths = spark.createDataFrame([("shop", 1, "/best-sellers/new_arrivals"), ("shop", 900, "/cart")], "site string, r int, path string")
    maps = spark.createDataFrame([("shop", "https://s.com/product-1.xml"), ("shop", "https://s.com/product-2.xml")], "site string, url string")
    got = {(r.site, r.kind): r.score for r in vocabulary.scores(p, paths, sitemaps=maps).collect()}
    texts = {"described": "Checkout and cart ", "visible": " ".join(shop.split()), "paths": " best sellers new arrivals"}
    want = sum(min(len(re.findall(t, x, re.I)), vocabulary.SOURCES[k][1]) * w * vocabulary.SOURCES[k][0] for k, x in texts.items() for t, w in vocabulary.TERMS["ecommerce"]) + 2 * vocabulary.SITEMAP
    assert got["shop", "ecommerce"] == round(want, 1) and ("food", "local_business") not in got  # no core term of theirs
    assert {(r.site, r.kind) for r in vocabulary.leading(vocabulary.scores(p, paths)).collect()} == {("shop", "ecommerce"), ("uni", "institutional")}
    assert {(r.kind, r.points) for r in vocabulary.sitemap_hints(maps).collect()} == {("ecommerce", 1.0)}
    inventory = p.select("site", "ord", "url", "page_type")
    kinds = lambda **k: {r.site: r.archetype for r in archetype.archetypes(p, inventory, **k).collect()}
    assert kinds(sitemaps=maps)["shop"] == "ecommerce" and kinds()["uni"] != "institutional" and kinds(words=False)["shop"] != "ecommerce"


def test_wording_and_contradictions(spark):
    from lakelens.operators import report

    recs = spark.createDataFrame(
        [("s", "R-001", "CHK-D-007", "k", "u1", "Consider whether"), ("s", "R-002", "CHK-D-008", "k", "u2", "please add a tag"), ("s", "R-003", "CHK-D-005", "k", "u3", " "), ("t", "R-001", "CHK-D-007", "k", "u4", "a guarantee of top ranking")],
        "site string, rec_id string, check_id string, defect_key string, url string, summary string",
    )
    kept, told = report.gate_wording(recs)
    assert {(r.site, r.rec_id) for r in kept.collect()} == {("s", "R-001"), ("t", "R-001")}
    assert {tuple(r) for r in told.collect()} == {("s", "prescriptive_wording", "R-002"), ("s", "empty_summary", "R-003"), ("t", "prohibited_wording", "R-001")}
    kept, told = report.drop_contradicted(recs, spark.createDataFrame([("s", "identity_jsonld"), ("s", "feed")], "site string, detector string"))
    assert {(r.site, r.rec_id) for r in kept.collect()} == {("s", "R-002"), ("s", "R-003"), ("t", "R-001")} and [tuple(r) for r in told.collect()] == [("s", "contradicted_by_strength", "R-001")]
    covered = spark.createDataFrame([("s", "CHK-D-008", "k", u) for u in ("u2", "u9")], "site string, check_id string, defect_key string, url string")
    assert {r.url for r in report.uncovered(recs, covered).collect()} == {"u1", "u3", "u4"}


def test_strengths(spark):
    import datetime

    from pyspark.sql import functions as F

    from lakelens.operators import report

    own = "<head><link rel=canonical href='{0}'><link rel=alternate type='application/rss+xml' href='/f'></head>"
    p = pages(spark, [(s, f"https://{s}/p{i}.md", own.format(f"https://{s}/p{i}.md") if s == "a" or i < 3 else "<body>x") for s, n in (("a", 3), ("b", 4), ("c", 6)) for i in range(n)])
    p = p.where("site <> 'c' or ord > 9")
    access = spark.createDataFrame([("a", "Zbot", "hybrid", True), ("a", "Abot", "retrieval", True), ("b", "Abot", "retrieval", False), ("z", "T", "hybrid", True)], "site string, agent string, class string, allowed_root boolean")
    day = lambda n: datetime.datetime(2026, 1, 1) - datetime.timedelta(days=n)
    maps = spark.createDataFrame([(s, f"t{i}", day(d)) for s, d in (("a", 89), ("b", 90), ("z", -1)) for i in range(6)], "site string, page_type string, lastmod timestamp")
    got = {(r.site, r.strength_id): (r.detector, r.evidence) for r in report.strengths(p, access, maps, F.lit(day(0))).collect()}
    assert [got["a", f"S-{i}"][0] for i in range(1, 6)] == ["sitemap_fresh", "feed_discovery", "canonical_consistency", "retrieval_crawler_access", "content_negotiation"]
    assert got["a", "S-4"][1] == "Abot" and [got["b", f"S-{i}"] for i in (1, 2)] == [("feed_discovery", "/f"), ("canonical_majority", "3/4")]
    assert got["z", "S-1"] == ("retrieval_crawler_access", "T") and ("z", "S-2") not in got and [k for k in got if k[0] == "c"] == [("c", "S-1")]


def test_reports_hold_all_checks(spark, tmp_path, monkeypatch):
    """Site, identity, trade, date and rendering checks reach every report query."""
    from lakelens.plans import queries

    body = "word " * 300 + "announced released launched "
    html_of = {"https://a.test/": "<body>x", "https://b.test/": f"<body><h1>Hello</h1>{'<img src=i>' * 4}{body}", "https://b.test/2024/05/01/q": f"<body><h1>News</h1><time datetime=2024-05-01>May</time>{body}", "https://c.test/shop/p": "<body>x"}
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(html_of.items())], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    once = queries._audited(spark, str(tmp_path))
    monkeypatch.setattr(queries, "_audited", lambda *_: once)
    monkeypatch.setattr(queries, "_evidence", lambda *_: once[0])
    got = {n: queries.queries()[n](spark, str(tmp_path)).collect() for n in ("envelope_state_counts", "site_findings", "site_recommendations", "summary_by_severity", "checks_passed", "top_priorities", "meta_warnings")}
    has = lambda n: {(r.site, r.check_id[4:]) for r in got[n]}
    every = {f"CHK-D-{n:03d}" for n in (3, 4, 6, 7, 8, 9, 12, 13, 25, 26, 27, 29, 30, 31, 32, 33, 34)} | {f"CHK-E-{n:03d}" for n in (14, 15, 19, 21, 24)}
    assert every <= {r.check_id for r in got["envelope_state_counts"]}
    assert ("a.test", "D-003") in has("site_findings") and ("b.test", "D-025") in has("site_findings")
    assert ("b.test", "E-021") in has("site_recommendations") and ("a.test", "E-021") in has("checks_passed") and ("b.test", "D-012") in has("checks_passed")
    assert ("a.test", "D-003") in has("top_priorities") and ("b.test", "D-025") in has("top_priorities")
    assert {r.site: r.total for r in got["summary_by_severity"]} == {s: sum(r.site == s for r in got["site_findings"]) for s in {r.site for r in got["site_findings"]}}
    assert got["meta_warnings"] == []
