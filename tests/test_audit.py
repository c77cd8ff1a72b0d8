"""Operators of the audit engine on small literal inputs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lakelens.functions import geometry, text, urls
from lakelens.operators import audit, checks, gated, html, report, robots, sampling, sections


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(rows.select("i", f(F.col("v"))).collect())]


def test_page_urls(spark):
    cases = {
        "https://a.test/x?next=5": True, "https://a.test/x?next=/account": False, "https://a.test/x?go=https%3A%2F%2Fe.test%2F": False, "https://a.test/session/new": False,
        "https://a.test/x/session/42": True, "https://a.test/wiki/Special:Log": False, "https://a.test/wiki/En:dash": True, "https://a.test/sitemaps/a.xml.gz": False,
        "https://a.test/pressure": True, "https://a.test/press/x": False, "https://a.test/": True,
    }
    assert column(spark, list(cases), urls.is_page_url) == list(cases.values())


def test_page_types_and_locales(spark):
    cases = {"https://a.test/": "home", "https://a.test/a.png": "asset", "https://a.test/login": "login", "https://a.test/docs/x": "documentation", "https://a.test/en/728": "documentation", "https://a.test/2024/05/x": "article", "https://docs.a.test/zzz": "documentation", "https://a.test/zzz": "other", "https://a.test/p/a1": "product"}
    assert column(spark, list(cases), urls.page_type) == list(cases.values())
    assert column(spark, ["https://a.test/de/x", "https://a.test/de-AT/x", "https://a.test/us/x", "https://a.test/", None], urls.url_locale) == ["de", "de", None, None, None]
    assert column(spark, ["www.a.co.uk", "x.y.a.com:80", "a.com", "localhost"], urls.registrable_domain) == ["a.co.uk", "a.com", "a.com", "localhost"]


def test_variant_kind(spark):
    pairs = [("/", "/fr/", "localised"), ("/en/5.0/x", "/en/5.1/x", "versioned"), ("/alpha/foo", "/alpha/barbaz", None), ("/a/b", "/a/b/c", None), ("/de/x", "/en/x", "localised")]
    rows = spark.createDataFrame([(i, "http://h" + a, "http://h" + b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r[1] for r in sorted(rows.select("i", urls.variant_kind(F.col("a"), F.col("b"))).collect())]
    assert got == [k for _, _, k in pairs]


def test_text(spark):
    t = ["One two three four. It works! They do?", "", None, "a b"]
    assert column(spark, t, text.pronoun_percent) == [67, None, None, 0]
    w = [re.findall(r"[A-Za-z0-9']+", (x or "").lower()) for x in t]
    expected = ["sha256:" + hashlib.sha256("\n".join(sorted({" ".join(x[i : i + 3]) for i in range(len(x) - 2)})).encode()).hexdigest() for x in w]
    assert column(spark, t, text.trigram_hash) == expected
    assert column(spark, ["It is a test now", "12 km away", "better than that", "plain"], text.has_evidence) == [True, True, True, False]


def test_geometry(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 0.0], [255.0, 255.0, 255.0])], "a array<double>, b array<double>")
    assert rows.select(geometry.contrast(F.col("a"), F.col("b"))).first()[0] == 21.0
    boxes = spark.createDataFrame([([(0.0, 0.0, 10.0, 10.0), (20.0, 0.0, 5.0, 5.0), (0.0, 40.0, 5.0, 5.0)],)], "t array<struct<x:double,y:double,w:double,h:double>>")
    assert boxes.select(geometry.spacing(F.col("t"))).first()[0] == [10.0, 10.0, 30.0]


ROBOTS = [
    ("User-agent: PerplexityBot\nAllow: /$\nDisallow: /", {"PerplexityBot": (True, None)}),
    ("User-agent: X\nAllow: /\nDisallow: /", {"X": (True, None)}),
    ("User-agent: A\nUser-agent: B\nDisallow: /", {"A": (False, 3), "B": (False, 3)}),
    ("User-agent: A\nDisallow: /\nUser-agent: A\nDisallow: /x", {"A": (True, None)}),
    ("Disallow: /\nUser-agent: A\nDisallow: /x # c", {"A": (True, None)}),
    ("User-agent: A\nSitemap: s\nUser-agent: B\nDisallow: /", {"A": (False, 4), "B": (False, 4)}),
    ("User-agent: A\nDisallow: *", {"A": (False, 2)}),
    ("User-agent: A\nDisallow:", {"A": (True, None)}),
    ("User-agent: A\r\nDisallow: /*", {"A": (False, 2)}),
]


def test_robots(spark):
    raw = spark.createDataFrame([(str(i), 200, body) for i, (body, _) in enumerate(ROBOTS)], "site string, fetch_status int, body string")
    got: dict = {}
    for r in robots.root_access(robots.status(raw)).collect():
        got.setdefault(int(r.site), {})[r.agent] = (r.allowed_root, r.matched_line)
    assert [got[i] for i in range(len(ROBOTS))] == [e for _, e in ROBOTS]
    codes = spark.createDataFrame([(str(s), s, "x") for s in (None, 200, 404, 410, 403, 429, 503)], "site string, fetch_status int, body string")
    assert {r.site: r.robots_status for r in robots.status(codes).collect()} == {"None": "unavailable", "200": "ok", "404": "ok", "410": "ok", "403": "unavailable", "429": "unavailable", "503": "unavailable"}


def test_crawl_findings(spark):
    raw = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /"), ("b", 200, "User-agent: GPTBot\nDisallow: /"), ("c", 200, "User-agent: GPTBot\nUser-agent: Claude-User\nDisallow: /"), ("d", 503, None)], "site string, fetch_status int, body string")
    got = {(r.site, r.check_id[-1]): r.state for r in robots.crawl_findings(robots.status(raw)).collect()}
    assert got == {("a", "1"): "absent", ("a", "2"): "absent", ("b", "1"): "absent", ("b", "2"): "present", ("c", "1"): "present", ("c", "2"): "not_applicable", ("d", "1"): "not_determinable", ("d", "2"): "not_determinable"}


PAGE = """<html lang="de-AT"><head><title>T</title><meta name="viewport" content="width=device-width"><link rel="canonical" href="https://www.h.test/p/">
<link rel="alternate" type="application/rss+xml" href="/feed"><script type="application/ld+json">{"@graph":[{"@type":["Organization"],"name":"A"}]}</script></head><body>
<nav><a href="/x">nav words</a></nav><main><h1>One</h1><p>First <b>para</p><h4>Skip</h4><img src=a><img src=b alt><img src=c aria-hidden=true><video autoplay></video><video autoplay=""></video>
<form><input id=q><input type=hidden><label>n <input id=r></label></form><button><svg><title>ok</title></svg></button><button></button><a href="mailto:a@b.co"></a><a rel=me href="https://m.test/@me"></a></main>
<footer>&copy; 2024 Acme, Inc. All rights reserved</footer></body></html>"""


def test_extractor(spark):
    x = html.extract(1, "h", 0, "https://www.h.test/p", PAGE)
    assert (x["title"], x["lang"], x["main_source"], x["canonical_self"], x["n_main"]) == ("T", "de-AT", "main", True, 1)
    assert x["main_text"].startswith("One First para Skip") and "nav words" not in x["main_text"]
    assert [h["level"] for h in x["headings"]] == [1, 4] and x["hero"] == "First para"[:10] or x["hero"].startswith("First para")
    assert [i["alt"] for i in x["images"]] == [None, "", None] and x["images"][2]["decorative"]
    assert [m["autoplay"] for m in x["media"]] == [False, True]
    assert [c["labelled"] for c in x["controls"]] == [False, True] and x["buttons_no_text"] == 1 and x["links_no_text"] == 1
    assert x["json_ld"][1]["types"] == ["organization"] and x["footer_text"] == "© 2024 Acme, Inc. All rights reserved" and x["email"] and x["feeds"] == ["/feed"]
    deep = html.extract(1, "h", 0, "u", "<body>" + "<div>" * 1500 + "deep")
    assert deep["main_source"] == "body"
    assert html.extract(1, "h", 0, None, None)["main_text"] == ""
    hero = lambda page: html.extract(1, "h", 0, "u", page)["hero"]
    assert x["hero"] == "First para" and hero("<h1>t</h1><p>open<p>First <b>one</b></p>") == "open First one" and hero("<h1>t</h1><p>never closed") is None  # up to an end tag
    told = html.extract(1, "h", 0, "u", """<body><p>On 3 May 2024 and 2024-05-04, October 31, 2024</p><link rel=alternate type='application/rss+xml' href='/f'>
<script type="application/ld+json">{"a": [{"datePublished": "2020-01-02"}], "datePublished": 7, "dateModified": "x"}</script>""")
    assert told["times"] == ["3 May 2024", "2024-05-04", "October 31, 2024"] and (told["jsonld_published"], told["jsonld_modified"]) == ("2020-01-02", "x") and told["feeds"] == []


def test_main_root():
    words = lambda n: "w " * n
    cases = {
        f"<body><section role=MAIN>a</section><div role=main>b</div>{words(99)}": ("b", "role_main"), f"<body><article>{words(60)}</article><article>{words(70)}x</article>": (words(70) + "x", "article"),
        f"<body><article>{words(40)}</article>{words(20)}": (words(60).strip(), "body"), f"<body><nav>{words(9)}<div id=k>{words(55)}</div></nav>a": (words(55).strip(), "fallback:div#k"), "<p>x": ("x", "root"), "<body>x": ("x", "body"),
    }
    for page, want in cases.items():
        x = html.extract(1, "h", 0, "u", page)
        assert (x["main_text"], x["main_source"]) == want, page


def test_footer_names(spark):
    cases = {
        "© 2024 Acme, Inc. All rights reserved": "Acme, Inc", "x (c) 2001-2024 by Bolt & Nuts | more": "Bolt & Nuts", "Copyright Terms Privacy Status": None, "© Square, Inc English Deutsch": "Square, Inc",
        "no mark": None, "© 2024": None, "© " + "long name " * 12: None, "© A": None, "COPYRIGHT 2020 – Zed": "Zed", None: None,
    }
    assert column(spark, list(cases), html.footer_org) == list(cases.values())


def test_pages_that_could_not_be_had(spark):
    """A 404, a failed fetch, another type and a blank body are unknown, never clean and never a defect."""
    rows = [(0, "a", 0, "https://a.test/", 404, {}, PAGE), (1, "a", 1, "https://a.test/x", None, {}, None), (2, "a", 2, "https://a.test/y", 200, {"content-type": "application/pdf"}, PAGE), (3, "a", 3, "https://a.test/z", 200, {}, " \n\u00a0"), (4, "b", 4, "https://b.test/", 200, {"Content-Type": "text/html; charset=x", "last-modified": "d"}, PAGE)]
    raw = spark.createDataFrame(rows, "page_id long, site string, ord int, url string, http_status int, headers map<string,string>, html string")
    x = {r.page_id: r for r in html.extract_pages(raw).collect()}
    assert [x[i].unavailable for i in range(5)] == ["http_404", "http_None", "non_html:application/pdf", "empty_body", None] and [x[i].extraction_ok for i in range(5)] == [False] * 4 + [True]
    assert x[0].title is None and x[0].raw_bytes == 0 and x[4].header_last_modified == "d"
    e = audit.gather(checks.typed(html.extract_pages(raw)))
    found = audit.audit(e).cache()
    bad = {r.check_id for r in found.where("site = 'a' and state in ('present', 'absent')").collect()}
    assert bad <= {"CHK-E-021", "CHK-E-024", "CHK-D-027"} or not bad  # site counts of what was read
    assert {r.state for r in found.where("site = 'a' and check_id in ('CHK-D-004', 'CHK-D-008', 'CHK-E-014', 'CHK-E-015', 'CHK-E-017', 'CHK-E-020', 'CHK-E-022', 'CHK-D-003')").collect()} == {"not_determinable"}
    tables = audit.compose(e, found)
    assert {r.site: (r.access, r.archetype) for r in tables["preambles"].collect()}["a"] == ("partial_block", "unknown")
    assert {r.lim_id for r in tables["limitations"].where("site = 'a'").collect()} - {r.lim_id for r in tables["limitations"].where("site = 'b'").collect()} == {"BUDGET-degraded_stages"}
    assert not [r for r in tables["findings"].collect() if r.site == "a"]


def pages(spark, rows):
    raw = spark.createDataFrame([(i, s, i, u, h) for i, (s, u, h) in enumerate(rows)], "page_id long, site string, ord int, url string, html string")
    return checks.typed(html.extract_pages(raw))


def test_checks_and_report(spark):
    rows = [("h", "https://h.test/zz1", PAGE), ("h", "https://h.test/zz2", PAGE), ("g", "https://g.test/", "<html lang=en><body><p>x"), ("f", "https://f.test/q", "<html>" + "<i></i>" * 2000)]
    env = checks.page_envelopes(pages(spark, rows)).cache()
    state = {(r.url, r.check_id): r.state for r in env.collect()}
    assert state["https://h.test/zz1", "CHK-E-020"] == "present" and state["https://h.test/zz1", "CHK-E-022"] == "present"
    assert state["https://f.test/q", "CHK-D-004"] == "not_determinable" and ("https://g.test/", "CHK-D-004") not in state
    assert not [k for k, v in state.items() if v == "present" and k[0] == "https://f.test/q"]  # unread pages are never blamed
    found = report.findings(report.roll_up(env))
    wide = {(r.site, r.check_id): (r.occurrences, r.severity, r.site_wide) for r in found.collect()}
    assert wide["h", "CHK-E-014"] == (2, "medium", True) and wide["h", "CHK-E-022"][0] == 2
    listed = report.instances(env)
    assert {(r.url, r.severity) for r in listed.collect() if r.check_id == "CHK-E-014"} == {("https://h.test/zz1", "medium"), ("https://h.test/zz2", "medium")}
    single = env.where("state = 'present' and not recommendation").select("site", "check_id", "defect_key", "url")
    assert {r.site for r in report.uncovered(single, listed).collect()} <= {"g"}  # h's pages are all covered
    e014 = next(r for r in env.collect() if (r.url, r.check_id) == ("https://h.test/zz1", "CHK-E-014"))
    assert e014.violations == 4 and e014.evidence.startswith("4 accessibility violation(s): missing alt")  # an image, a link, a button and a control
    recs, sums, passed = report.recommendations(env), report.summary(found), report.checks_passed(env)
    assert report.warnings(found, sums, passed, recs).count() == 0
    assert all(r.klass <= 2.5 for r in report.top_priorities(found, recs).collect())
    assert report.reports(env, found, recs, sums, passed).count() == 3


def test_near_duplicate_pages(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    docs = [base, base[:110] + [rng.choice(words) for _ in range(10)], base[:60] + [rng.choice(words) for _ in range(60)], [rng.choice(words) for _ in range(90)], base]
    rows = [("s", f"https://s.test/page{i}", f"<body><main>{' '.join(d)}</main>") for i, d in enumerate(docs)] + [("t", "https://t.test/page", f"<body><main>{' '.join(base)}</main>")]
    sets = [{tuple(d[i : i + 3]) for i in range(len(d) - 2)} for d in docs]
    expected = {(f"https://s.test/page{i}", f"https://s.test/page{j}") for i in range(5) for j in range(i + 1, 5) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.8}
    got = {(r.url_a, r.url_b) for r in checks.near_duplicate_pages(pages(spark, rows)).collect()}
    assert got == expected and expected


def test_near_duplicates_are_found_once_from_numbers(spark):
    """Candidates are stored, and only their pages are compared; texts of trigrams meet in no join."""
    p = pages(spark, [("s", f"https://s.test/page{i}", f"<body><main>{'one two three four ' * 20} {k}</main>") for i, k in enumerate("aab")] + [("t", "https://t.test/x", "<body>one two three four")])
    found = checks.near_duplicate_pages(p)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "Window" not in plan
    assert [(r.url_a[-1], r.url_b[-1], r.similarity) for r in found.orderBy("url_a", "url_b").collect()] == [("0", "1", 1.0)]
    three = checks.text.trigram_keys(checks.F.col("main_text"))
    assert {r.site: r.n for r in p.select("site", checks.F.size(three).alias("n")).where("page_id in (0, 3)").collect()} == {"s": 5, "t": 2}


def test_extractor_holds_few_pages_at_a_time(spark, monkeypatch):
    """Every page of a batch that is cut comes out, and searches that are left out find nothing."""
    from lakelens.operators import html

    page = "<body>{}<footer>x</footer>"
    found = lambda t: {k: v for k, v in html.extract(0, "s", 0, "https://s.test/", page.format(t)).items() if k in ("email", "phone", "shop_html")}
    assert found("call 030 1234567 or a@b.io") == {"email": True, "phone": "030 1234567", "shop_html": False}
    assert found("12 34 and @") == {"email": False, "phone": None, "shop_html": False}
    assert [found(t)["shop_html"] for t in ("Add-To-Cart", "ſhopıfy.theme", "a cart")] == [True, True, False]
    rows = [("s", f"https://s.test/{i}", "<body>x") for i in range(2 * html.AT_ONCE + 50)]
    assert sorted(r.page_id for r in pages(spark, rows).select("page_id").collect()) == list(range(len(rows)))


def test_identity_pages(spark):
    rows = [("h", "https://h.test/", '<body><a href="/about/">a</a>'), ("h", "https://h.test/about", "<body>x"), ("h", "https://h.test/contact", "<body>x")]
    assert {r.url for r in checks.identity_pages(pages(spark, rows)).collect()} == {"https://h.test/", "https://h.test/about"}


def test_sections(spark):
    rows = spark.createDataFrame([("s", i, f"u{i}", st, how) for i, (st, how) in enumerate([(200, None), (301, None), (403, None), (404, "HEAD"), (404, "GET"), (None, None), (500, None), (200, None), (200, None)])], "site string, ord int, url string, http_status int, confirmed_by string")
    got = sections.anchors(rows)
    assert [r.resolved for r in got.orderBy("ord").collect()] == [True, True, None, None, False, None, False, True]
    assert sections.anchors(rows, declared=rows.limit(0).select("site", "url")).count() == 0
    assert {tuple(r) for r in sections.status(spark.createDataFrame([("s",), ("t",)], "site string"), rows, "no_links").collect()} == {("s", "ok", None), ("t", "unavailable", "no_links")}
    assert sections.bundle(spark.createDataFrame([("s",)], "site string"), most=2, anchors=rows).first().anchors[1].url == "u1"
    stages = spark.createDataFrame([("s", "a", 1.25, False), ("s", "b", None, True)], "site string, name string, actual_s double, abandoned boolean")
    assert tuple(sections.budget(stages).first()[1:]) == (1.2, 300.0, ["b"])


def test_sitemap_lines_and_rules(spark):
    raw = spark.createDataFrame([("a", 200, "Sitemap: https://a/s.xml\nUser-agent: Claude-User\nDisallow: /*\nDisallow: /\nDisallow: /x\nsitemap:  https://a/t.xml # c")], "site string, fetch_status int, body string")
    ok = robots.status(raw)
    assert [(r.line, r.url) for r in robots.sitemaps(ok).orderBy("line").collect()] == [(1, "https://a/s.xml"), (6, "https://a/t.xml")]
    (r,) = robots.root_access(ok).collect()
    assert r.disallow_rules == ["/", "/*"] and not r.allowed_root
    (d,) = [x for x in robots.crawl_envelopes(ok).collect() if x.check_id == "CHK-D-001"]
    assert (d.state, d.severity, d.evidence) == ("present", "critical", "claude-user (line 3 by /)")


ORG = '<script type="application/ld+json">{"@type": "Organization", "name": "A", "url": "https://a.test", "sameAs": ["https://x.com/acme", "https://e.test/a"]}</script>'


def test_audit_of_whole_evidence(spark):
    """Robots, links, anchors, duplicates, aliases and stages given up reach one report."""
    text = " ".join(f"w{i % 37}x{i}" for i in range(260))
    rows = [("a.test", "https://a.test/", ORG + f"<body><h1>t</h1>{text}"), *[("a.test", f"https://a.test/p/{k}", f"<body><main><h1>t</h1>{text} {k}</main>") for k in ("alpha", "bravo", "carol")]]
    rows += [("b.test", "https://b.test/q", "<body>x"), ("b.test", "https://b.test/q/", "<body>y"), ("c.test", "https://c.test/", "<body>x")]
    rows += [("v.test", f"https://v.test/{k}/page", f"<body><main><h1>t</h1>{text}</main>") for k in ("en", "de")] + [("v.test", "https://v.test/zzzzz", "<body><h1>t</h1>other words here")]
    raw = spark.createDataFrame([("a.test", 200, "User-agent: Claude-User\nDisallow: /"), ("c.test", 503, None)], "site string, fetch_status int, body string")
    links = spark.createDataFrame([("a.test", i, f"https://a.test/l{i}", s, "https://a.test/", None) for i, s in enumerate([404, 200, 500, 410, 403])] + [("b.test", 0, "https://b.test/l", 200, None, None)], "site string, ord int, url string, http_status int, from_page string, anchor_text string")
    anchors = spark.createDataFrame([("a.test", 0, "https://x.com/acme", 404, "GET"), ("a.test", 1, "https://e.test/a", 200, None), ("a.test", 2, "https://other.test/", 500, None)], "site string, ord int, url string, http_status int, confirmed_by string")
    stages = spark.createDataFrame([("b.test", "static_fetch", 1.0, 1.0, True, 9, 2, "slow"), ("a.test", "render_pass", 1.0, 1.0, True, 3, 0, "none")], sections.STAGES)
    e = audit.gather(pages(spark, rows), raw_robots=raw, links=links, anchors=anchors, stages=stages)
    found = audit.audit(e).cache()
    one = {(r.site, r.check_id[4:]): r for r in found.collect()}
    assert "c.test" not in {r.site for r in found.collect() if r.check_id not in ("CHK-D-001", "CHK-D-002")}  # nothing of it was to be fetched
    assert one["a.test", "D-001"].state == "present" and one["c.test", "D-001"].state == "not_determinable"
    assert (one["a.test", "D-009"].state, one["a.test", "D-009"].violations, one["a.test", "D-009"].url) == ("present", 4, "https://a.test/")
    assert one["a.test", "D-009"].evidence.startswith("4 broken: https://a.test/l0 responded 404 from https://a.test/; https://a.test/l2") and one["b.test", "D-009"].state == "absent" and one["v.test", "D-009"].state == "not_determinable"
    assert (one["a.test", "D-026"].state, one["a.test", "D-026"].severity, one["a.test", "D-026"].evidence) == ("present", "medium", "1 of 2 declared addresses did not resolve")
    assert (one["a.test", "D-013"].state, one["a.test", "D-013"].defect_key) == ("present", "near_duplicates") and (one["v.test", "D-013"].state, one["v.test", "D-013"].defect_key) == ("present", "variants") and one["b.test", "D-013"].state == "not_determinable"
    strength = {r.url: r.strength for r in found.where("check_id = 'CHK-D-008'").collect()}
    assert strength["https://b.test/q"] == strength["https://b.test/q/"] == "CAUSAL" and strength["https://v.test/zzzzz"] == "NORMATIVE"
    assert {r.url for r in gated.anchor_urls(e.pages).collect()} == {"https://x.com/acme", "https://e.test/a"}
    tables = audit.compose(e, found)
    passed = {(r.site, r.check_id[4:]) for r in tables["checks_passed"].collect()}
    assert ("a.test", "E-018") not in passed and not {c for s, c in passed if s == "b.test"} - {"D-001", "D-002", "D-026"}  # their input was given up
    assert {(r.site, r.stage) for r in tables["degraded_stages"].collect()} == {("a.test", "render_pass"), ("b.test", "static_fetch")}
    assert next(r.notes for r in tables["preambles"].collect() if r.site == "a.test")[0] == report.BLOCKED_NOTE
    assert {r.check_id[4:] for r in tables["findings"].where("site = 'a.test'").collect()} >= {"D-001", "D-026"} and tables["warnings"].count() == 0
    top = tables["top_priorities"].where("site = 'a.test' and place = 1").first()
    assert top.check_id == "CHK-D-001"
    whole = {r.site: r for r in audit.reports(e, tables).collect()}
    assert set(whole) == {"a.test", "b.test", "c.test", "v.test"} and whole["a.test"].findings[0].finding_id == "F-001" and len(whole["b.test"].limitations) == 5


def test_more_analysers(spark, monkeypatch):
    monkeypatch.setattr(audit, "ANALYSERS", dict(audit.ANALYSERS))
    names = [x.split(" ")[0] for x in audit.ENVELOPE.split(", ")]
    audit.register("own", lambda e: e.sites.selectExpr("site", "1L << 50 AS seq", "site AS url", "'OWN-1' AS check_id", "'present' AS state", "'high' AS severity", "'own' AS strength", "false AS recommendation", "'k' AS defect_key", "1 AS violations", "'e' AS evidence").select(*names))
    audit.register("nothing", lambda e: None)
    e = audit.gather(pages(spark, [("g", "https://g.test/", "<body>x")]))
    found = audit.audit(e).cache()
    assert found.where("check_id = 'OWN-1'").count() == 1
    assert {r.check for r in audit.compose(e, found)["warnings"].collect()} >= {"known_check_id", "finding_complete"}


def test_report_contradictions(spark):
    """Each self-check fires on a report that is wrong in that way, and on no sound one."""
    found = spark.createDataFrame(
        [("s", "F-001", "CHK-D-008", "k", "high", "NORMATIVE", "https://s/aaaa", "t", "e", 1, "see /bbbb"), ("s", "F-002", "CHK-D-008", "k", "high", "NORMATIVE", "https://s/bbbb", "", "e", 1, "fine"), ("s", "F-003", "ODD", "k", "odd", "x", None, "t", None, 1, "")],
        "site string, finding_id string, check_id string, defect_key string, severity string, strength string, url string, title string, evidence string, occurrences int, action string",
    )
    recs = spark.createDataFrame([("s", "R-001", "CHK-D-005", "add a <h1>")], "site string, rec_id string, check_id string, summary string")
    passed = spark.createDataFrame([("s", "CHK-D-005")], "site string, check_id string")
    sums = report.summary(found).selectExpr("site", "total + 1 AS total", *report.SEVERITIES)
    limits = spark.createDataFrame([("s", "LIM-01")], "site string, lim_id string")
    got = {r.check for r in report.warnings(found, sums, passed, recs, limits).collect()}
    assert got == {"summary_reconciles", "severity_counts_reconcile", "finding_complete", "no_duplicate_findings", "known_check_id", "prohibited_recommendation", "limitations_present", "action_locus_coherence", "passed_and_advised"}


def test_evidence_dates(spark):
    cases = ["2024-05-01", "2024-05-01T10:00:00Z", "2024-05-01T10:00:00+02:00", "2024-05-01 10:00", "May 1", "", None, "2024-13-01"]
    stamps = column(spark, cases, lambda c: F.unix_timestamp(report.evidence_date(c)))
    assert stamps == [1714521600, 1714557600, 1714550400, 1714557600, None, None, None, None]


def test_masked_evidence_and_remedies(spark):
    assert column(spark, ["Page https://a/1 has 3", None], report.masked) == ["Page <url> has <n>", ""]
    assert column(spark, ["2 accessibility violation(s): missing lang attribute; unlabelled form control", "x"], checks.remedies) == ["a declared page language; programmatic labels for form controls", None]


@pytest.mark.parametrize("parts", [1, 5])
def test_sample(spark, parts):
    rows = [("a", i, f"https://a.test/{f}/{i}", "other" if f != "docs" else "documentation") for i, f in enumerate(["docs", "x", "y", "z"] * 10)]
    rows += [("a", 100, "https://a.test/", "home"), ("a", 101, "https://a.test/about", "about"), ("a", 102, "https://a.test/login", "login"), ("b", 0, "https://b.test/q", "other")]
    inv = spark.createDataFrame(rows, "site string, ord int, url string, page_type string").repartition(parts)
    got = sorted((r.site, r.place, r.url) for r in sampling.static_sample(inv).collect())
    a = [u for s, _, u in got if s == "a"]
    assert a[:2] == ["https://a.test/", "https://a.test/about"] and len(a) == len(set(a)) == 14 and "https://a.test/login" not in a  # 2 fixed, 4 families, 4 of each type
    assert [u for s, _, u in got if s == "b"] == ["https://b.test/q"]
