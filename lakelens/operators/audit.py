"""One audit of many sites: every analyser's envelopes in one table, and the report made of them.

An analyser is a function of the evidence that returns envelopes, or None where it has nothing to go
by. More can be registered; the report reads whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, stored
from . import archetype, checks, gated, rendered, report, robots, sections

ENVELOPE = (
    "site string, seq long, url string, check_id string, state string, severity string, strength string, recommendation boolean, defect_key string, violations int, evidence string"
)


@dataclass
class Evidence:
    """Tables of a collection. pages are checks.typed() ones; what wasn't collected is None."""

    pages: DataFrame
    sites: DataFrame
    robots: DataFrame | None = None  # robots.status()
    links: DataFrame | None = None  # sources.LINKS
    anchors: DataFrame | None = None  # sections.anchors()
    rendered: DataFrame | None = None  # rendered.RENDERED
    stages: DataFrame | None = None  # sections.STAGES

    def empty(self, schema: str) -> DataFrame:
        return self.pages.sparkSession.createDataFrame([], schema)

    @property
    def renderings(self) -> DataFrame:
        return self.rendered if self.rendered is not None else self.empty(rendered.RENDERED)


def gather(pages: DataFrame, inventory: DataFrame | None = None, raw_robots: DataFrame | None = None, links: DataFrame | None = None, anchors: DataFrame | None = None, heads: DataFrame | None = None, sitemaps: DataFrame | None = None, **more) -> Evidence:
    """Evidence of typed() pages, which are parsed and written here once; the inventory is the pages themselves where none is given.

    heads (site, t) of raw markup, robots and sitemaps (site, url) also tell the kind of a site; the
    sitemaps that robots.txt names are taken where none are given.

    Sites whose robots.txt couldn't be had are dropped from everything else: nothing of theirs was
    to be fetched, so nothing is judged.
    """
    statuses = None if raw_robots is None else robots.status(raw_robots)
    if statuses is not None:
        pages, links, anchors = (None if t is None else sections.reachable(t, statuses) for t in (pages, links, anchors))
    pages = stored(pages)
    listed = pages.select("site", "ord", "url", "page_type") if inventory is None else inventory
    if sitemaps is None and statuses is not None:
        sitemaps = robots.sitemaps(statuses).select("site", "url")
    known = stored(archetype.archetypes(pages, listed, heads, statuses, sitemaps))
    return Evidence(pages, known, statuses, None if links is None else sections.links(links), None if anchors is None else sections.anchors(anchors), **more)


#: In the order of a report.
ANALYSERS: dict[str, Callable[[Evidence], DataFrame | None]] = {
    "crawl": lambda e: None if e.robots is None else robots.crawl_envelopes(e.robots),
    "home": lambda e: rendered.home_envelopes(e.pages, e.renderings),
    "page": lambda e: checks.with_context(checks.page_envelopes(e.pages), checks.aliases(e.pages), e.sites),
    "rendered_page": lambda e: rendered.page_envelopes(e.pages, e.renderings),
    "rendering": lambda e: rendered.rendering_envelopes(e.renderings),
    "links": lambda e: checks.link_envelopes(e.links if e.links is not None else e.empty("site string, ord int, url string, http_status int, from_page string, anchor_text string"), e.sites),
    "duplicates": lambda e: checks.duplicate_envelopes(e.pages),
    "shift": lambda e: checks.site_envelopes(e.pages),
    "identity": lambda e: gated.identity_envelopes(e.pages, e.sites),
    "anchors": lambda e: gated.anchor_envelopes(e.pages, e.sites, e.anchors if e.anchors is not None else e.empty("site string, url string, resolved boolean")),
    "trade": lambda e: gated.trade_envelopes(e.pages, e.sites),
    "dates": lambda e: gated.date_envelopes(e.pages),
}


def register(name: str, analyser: Callable[[Evidence], DataFrame | None]) -> None:
    """Adds an analyser to every audit from now on, after the others; its rows have the columns of ENVELOPE."""
    ANALYSERS[name] = analyser


def audit(e: Evidence) -> DataFrame:
    """All envelopes of all sites. Each analyser's rows are written to one table in turn, so that no plan holds them all."""
    names, path = [x.split(" ")[0] for x in ENVELOPE.split(", ")], shared_folder(e.pages.sparkSession)
    e.empty(ENVELOPE).write.parquet(path)
    for analyser in ANALYSERS.values():
        if (found := analyser(e)) is not None:
            found.select(*names).write.mode("append").parquet(path)
    return e.pages.sparkSession.read.schema(ENVELOPE).parquet(path)


def compose(e: Evidence, envelopes: DataFrame, strengths: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a report, from a stored table of envelopes.

    Checks passed are told before the gates drop recommendations, priorities after them.
    """
    stages = e.stages if e.stages is not None else e.empty(sections.STAGES)
    degraded = report.degraded_stages(stages)
    access = stored(report.access_state(e.pages, degraded))
    found = report.findings(report.roll_up(envelopes))
    found = found.withColumn("action", F.concat(F.lit("Consider what this means for readers and crawlers: "), F.lower("title"), F.lit(".")))
    found, advised = stored(found), stored(report.recommendations(envelopes))
    passed = stored(report.checks_passed(envelopes, report.starved_checks(degraded, access)))
    limits = stored(report.limitations(access, found))
    strengths = stored(strengths) if strengths is not None else e.empty("site string, strength_id string, detector string, evidence string")
    kept, contradicted = report.drop_contradicted(advised, strengths)
    kept, worded = report.gate_wording(kept)
    kept, sums = stored(kept), report.summary(found)
    warned = reduce(DataFrame.unionByName, [contradicted, worded, report.warnings(found, sums, passed, kept, limits)])
    return {
        "findings": found, "recommendations": kept, "instances": report.instances(envelopes), "summary": sums, "checks_passed": passed, "access": access, "degraded_stages": degraded,
        "limitations": limits, "preambles": report.preambles(access, e.sites, envelopes), "strengths": strengths, "warnings": warned, "top_priorities": report.top_priorities(found, kept),
    }


def reports(e: Evidence, tables: dict[str, DataFrame]) -> DataFrame:
    """One nested row a site, for export; instances stay a table of their own, as they are unbounded."""
    every = e.sites.select("site").unionByName(e.robots.select("site")).distinct() if e.robots is not None else e.sites
    more = {k: tables[k] for k in ("limitations", "preambles", "strengths", "degraded_stages", "top_priorities")}
    return report.reports(every, tables["findings"], tables["recommendations"], tables["summary"], tables["checks_passed"], **more)
