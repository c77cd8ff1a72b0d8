"""The stratified page sample of each site, and the seed that names its inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

MOST_PAGES, MOST_OF_TYPE = 20, 4


def sampling_seed(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("site").agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list("url")), "\n").cast("binary"), 256)).alias("seed"))


def static_sample(inventory: DataFrame, most: int = MOST_PAGES, per_type: int = MOST_OF_TYPE) -> DataFrame:
    """site, url, page_type, place: at most `most` pages of each site from (site, ord, url, page_type).

    A home, an about and a contact page come first; then one page of each path family not yet
    there; then types in proportion to their pages, at most per_type each, the rest to the largest
    types. Pages in another language than the home page's URL are left out unless nothing remains.
    """
    home = inventory.where("page_type = 'home'").groupBy("site").agg(F.min_by("url", "ord").alias("seed"))
    rows = inventory.where(~F.col("page_type").isin("login", "asset") & urls.is_page_url(F.col("url"))).groupBy("site", "url").agg(F.min("page_type").alias("page_type"))
    rows = rows.join(home, "site", "left").withColumn("want", urls.url_locale(F.col("seed"))).withColumn("own", urls.url_locale(F.col("url")))
    fits = F.col("want").isNull() | F.col("own").isNull() | (F.col("own") == F.col("want"))
    whole = Window.partitionBy("site")
    rows = rows.withColumn("fits", fits).withColumn("any", F.max(fits).over(whole)).where("fits or not any")
    rows = rows.withColumn("family", F.coalesce(F.get(urls.segments(F.col("url")), F.lit(0)), F.lit("")))
    kind = Window.partitionBy("site", "page_type").orderBy("url")
    first = F.when(F.col("page_type").isin("home", "about", "contact") & (F.row_number().over(kind) == 1), F.when(F.col("page_type") == "home", 1).when(F.col("page_type") == "about", 2).otherwise(3))
    rows = rows.withColumn("fixed", first)
    rows = rows.withColumn("n_fixed", F.count("fixed").over(whole))
    taken = F.max(F.col("fixed").isNotNull()).over(Window.partitionBy("site", "family"))
    rows = rows.withColumn("taken", taken)
    lead = Window.partitionBy("site", "family", F.col("fixed").isNull()).orderBy("page_type", "url")
    rows = rows.withColumn("head", F.col("fixed").isNull() & ~F.col("taken") & (F.row_number().over(lead) == 1))
    slots = F.greatest(F.lit(0), F.least(F.lit(most) - F.col("n_fixed") - 1, F.count_if("head").over(whole)))
    turn = F.row_number().over(Window.partitionBy("site", "head").orderBy("family"))
    rows = rows.withColumn("slots", slots).withColumn("turn", F.when(F.col("head"), turn)).withColumn("diverse", F.coalesce(F.col("head") & (F.col("turn") <= F.col("slots")), F.lit(False)))
    rest = rows.where("fixed is null and not diverse")
    rest = rest.withColumn("budget", F.lit(most) - F.col("n_fixed") - F.col("slots")).withColumn("total", F.count("*").over(whole))
    types = rest.groupBy("site", "page_type", "budget", "total").agg(F.count("*").alias("n"))
    share = F.least(F.bround(F.col("budget") * F.col("n") / F.col("total")).cast("long"), F.lit(per_type).cast("long"), F.col("n"))
    types = types.withColumn("share", share).withColumn("left", F.col("budget") - F.sum(share).over(whole))
    room = F.greatest(F.lit(0), F.least(F.lit(per_type), F.col("n")) - F.col("share"))
    before = F.coalesce(F.sum(room).over(Window.partitionBy("site").orderBy(F.desc("n"), "page_type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    types = types.withColumn("quota", F.col("share") + F.greatest(F.lit(0), F.least(room, F.col("left") - before))).select("site", "page_type", "quota")
    rest = rest.join(types, ["site", "page_type"]).withColumn("r", F.row_number().over(Window.partitionBy("site", "page_type").orderBy("url"))).where("r <= quota")
    step = lambda df, n, *key: df.select("site", "url", "page_type", F.lit(n).alias("step"), *[k.alias(f"k{i}") for i, k in enumerate(key)])
    chosen = step(rows.where("fixed is not null"), 0, F.col("fixed").cast("string"), F.lit(""))
    chosen = chosen.unionByName(step(rows.where("diverse"), 1, F.col("family"), F.lit(""))).unionByName(step(rest, 2, F.col("page_type"), F.col("url")))
    place = F.row_number().over(Window.partitionBy("site").orderBy("step", "k0", "k1", "url"))
    return chosen.select("site", "url", "page_type", place.alias("place")).where(F.col("place") <= most)


def static_sample_of_pages(pages: DataFrame) -> DataFrame:
    """static_sample of a crawl table (page_id, url, html), a site for each host."""
    url = F.col("url")
    return static_sample(pages.select(urls.host(url).alias("site"), F.col("page_id").alias("ord"), "url", urls.page_type(url).alias("page_type")))


def virtual_inventory(inventory: DataFrame, pages: DataFrame, most: int = 500) -> DataFrame:
    """Rows of an inventory (site, ord, url, page_type), then internal web links of pages, one for each host and path.

    Links come while a site has fewer than `most` rows; the inventory's own rows all stay. A row without a type gets one by its URL.
    """
    bare = F.regexp_replace(urls.path(F.col("url")), "/+$", "")
    links = pages.select("site", "ord", F.posexplode("links").alias("k", "l")).where("l.internal").select("site", F.col("l.href").alias("url"), F.lit(None).cast("string").alias("page_type"), F.lit(1).alias("rank"), "ord", "k")
    links = links.where(urls.scheme(F.col("url")).isin("http", "https"))
    own = inventory.select("site", "url", "page_type", F.lit(0).alias("rank"), "ord", F.lit(0).alias("k"))
    both = own.unionByName(links).withColumn("key", F.concat(urls.host(F.col("url")), bare))
    order = ("rank", "ord", "k", "url")
    one = both.withColumn("r", F.row_number().over(Window.partitionBy("site", "key").orderBy(*order))).where("r = 1")
    one = one.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy(*order)))
    return one.where((F.col("rank") == 0) | (F.col("r") <= most)).select("site", "url", F.coalesce("page_type", urls.page_type(F.col("url"))).alias("page_type"), "r")
