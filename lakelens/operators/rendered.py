"""Checks that need a rendered page: render gap, contrast, target size, overlays, blank first paint.

Where no rendering was made, what static HTML tells one-sidedly is still told; the rest is
not_determinable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .checks import _row

RENDERED = (
    "site string, ord int, url string, status string, words int, h1_count int, targets array<struct<w:double,h:double,standalone:boolean>>, "
    "overlays array<struct<hint:string,coverage:double>>, scroll_locked boolean, overflow boolean, contrast array<struct<ratio:double,font_px:double,bold:boolean>>"
)
HOME_SEQ, RENDERED_SEQ = 2 << 40, 3 << 40


def home_pages(pages: DataFrame) -> DataFrame:
    """One row for each site: home, a struct of its first home page, or null."""
    fields = F.struct("url", "extraction_ok", "words", "headings", "noscript_words", "json_ld", "title", "hero", "description", "email")
    return pages.groupBy("site").agg(F.min_by(F.when(F.col("page_type") == "home", fields), F.when(F.col("page_type") == "home", F.col("ord"))).alias("home"))


def _first(rendered: DataFrame) -> DataFrame:
    """The first rendering of each page."""
    names = [c for c in rendered.columns if c not in ("site", "url")]
    return rendered.groupBy("site", "url").agg(F.min_by(F.struct(*names), "ord").alias("r"))


def _exploded(df: DataFrame, base, rows) -> DataFrame:
    each = df.select("site", base.alias("base"), "url", F.posexplode(F.array_compact(F.array(*rows))).alias("k", "e"))
    return each.select("site", (F.col("base") + F.col("k")).alias("seq"), "url", "e.*")


def home_envelopes(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """Envelopes of the render gap (D-003) and blank first paint (E-019), a row for each site and check.

    A site whose render gap is present has its first paint suppressed, as one cause explains both.
    """
    c = F.col
    homes = home_pages(pages).withColumn("url", c("home.url"))
    df = homes.join(_first(rendered), ["site", "url"], "left")
    words, after, quiet = c("home.words"), F.coalesce("r.words", F.lit(0)), F.coalesce("home.noscript_words", F.lit(0))
    h1 = F.size(F.filter("home.headings", lambda h: h["level"] == 1))
    unread = c("home").isNull() | ~F.coalesce("home.extraction_ok", F.lit(False))
    seen = F.coalesce(c("r.status") == "ok", F.lit(False))
    gap = F.when(after > 0, (after - words) / after).otherwise(0.0)
    bare = (h1 == 0) & (words < 50)
    severity = (
        F.when(unread | (quiet > 50), None).when(~seen, F.when(bare, "high"))
        .when(gap < 0.2, None).when(bare & (after >= 200), "critical").when((h1 >= 1) & (gap >= 0.6), "medium").otherwise("low")
    )
    gap_state = F.when(unread, "not_determinable").when(severity.isNotNull(), "present").when(~seen & (quiet <= 50), "not_determinable").otherwise("absent")
    blank = (words < 50) & (~seen | (after >= 200))
    paint = F.when(unread, "not_determinable").when(quiet >= 50, "absent").when(blank, "present").when(~seen, "not_determinable").otherwise("absent")
    paint = F.when((paint == "present") & (gap_state == "present"), "suppressed").otherwise(paint)
    rows = [
        _row("CHK-D-003", gap_state, severity, "HARD-MECHANICAL", False, "render_gap"),
        _row("CHK-E-019", paint, F.when(paint == "present", "high"), "HARD-MECHANICAL/CAUSAL", False, "blank_first_paint"),
    ]
    return _exploded(df, F.lit(HOME_SEQ), rows)


def page_envelopes(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """Envelopes of contrast (E-014) and sideways scrolling (E-015) of pages with their rendering."""
    c = F.col
    df = pages.select("site", "ord", "url", "extraction_ok").join(_first(rendered), ["site", "url"], "left")
    seen = F.coalesce((c("r.status") == "ok") & c("extraction_ok"), F.lit(False))
    weak = F.size(F.filter(F.coalesce("r.contrast", F.array()), lambda p: F.coalesce(geometry.contrast_fails(p["ratio"], F.coalesce(p["font_px"], F.lit(0.0)), F.coalesce(p["bold"], F.lit(False))), F.lit(False))))
    state = F.when(~seen, "not_determinable").when(weak > 0, "present").otherwise("absent")
    rows = [
        _row("CHK-E-014", state, F.when(state == "present", "medium"), "NORMATIVE", True, "contrast", weak),
        F.when(seen & F.coalesce("r.overflow", F.lit(False)), _row("CHK-E-015", F.lit("present"), "medium", "NORMATIVE", True, "overflow")),
    ]
    return _exploded(df, c("ord").cast("long") * 100 + 90, rows)


def rendering_envelopes(rendered: DataFrame) -> DataFrame:
    """Envelopes of small targets (E-016) and blocking overlays (E-018), for each rendering."""
    c = F.col
    seen = F.coalesce(c("status") == "ok", F.lit(False))
    less = lambda x: F.coalesce(x < 24, F.lit(False))  # noqa: E731  unmeasured sides count as large enough
    small = F.size(F.filter(F.coalesce("targets", F.array()), lambda t: F.coalesce(t["standalone"], F.lit(False)) & (less(t["w"]) | less(t["h"]))))
    blocked = F.exists(F.coalesce("overlays", F.array()), lambda o: o["hint"] == "none") & F.coalesce("scroll_locked", F.lit(False))
    told = lambda fires: F.when(~seen, "not_determinable").when(fires, "present").otherwise("absent")
    rows = [
        _row("CHK-E-016", told(small > 0), F.when(seen & (small > 0), "medium"), "NORMATIVE", False, "small_targets", small),
        _row("CHK-E-018", told(F.coalesce(blocked, F.lit(False))), F.when(seen & blocked, "high"), "NORMATIVE", False, "blocking_overlay"),
    ]
    return _exploded(rendered, F.lit(RENDERED_SEQ) + c("ord").cast("long") * 10, rows)
