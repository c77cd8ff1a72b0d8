"""Mixing sources to target weights by Pareto order sampling.

A source's target is shared out by weight and stops at a number of copies of the whole source. Each
document's expected copies are its source's target over its size (times a document weight, if one
is given); whole copies are certain, and the rest is an inclusion probability p. Documents are
ranked by Pareto's random odds (u / (1 - u)) / (p / (1 - p)) and taken in that order until the words
left to the source are filled, so samples have a fixed size and unequal probabilities. u is a hash
of seed and row: reruns agree. Rows that agree in every column are one item with a number of copies,
so that however many there are, no task sorts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, scratch, spread_join, stored, with_row_key

#: Refinements of the order before rows themselves are sorted, and the bins of each.
LEVELS, BINS = 2, 256
#: Up to this many sources (a few MB of totals) their table is broadcast; beyond, only hot ones' rows are.
FEW = 20_000


def _sources(base: DataFrame, weights: tuple, share: float, most: float, path: str) -> DataFrame:
    """key, source_size, rows, target: weights repeat over sources by code point, null last.

    share times all sizes is dealt by weight; what a source has above most times its size is dealt
    again among the others by weight, until none is above. Only sums reach the driver.
    """
    sizes = base.groupBy("key").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("rows"))
    place = F.row_number().over(Window.orderBy("key")) - 1  # of names, not of documents
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sizes = stored(sizes.withColumn("w", given).withColumn("most", F.col("source_size") * float(most)), f"{path}/sizes")
    goal, open_weight = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * float(share), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level, capped = goal / open_weight if open_weight else 0.0, -1
    while open_weight:
        above = F.col("w") * level > F.col("most")
        fixed, weight, n = sizes.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0)), F.count_if(above)).first()
        if n == capped or not weight:
            break
        level, capped = (goal - fixed) / weight, n
    return sizes.select("key", "source_size", "rows", F.least(F.col("w") * level, F.col("most")).alias("target"))


def _items(docs: DataFrame, id_col, text_col, source_col, weights, share, most, seed, weight_col) -> tuple[DataFrame, list[str]]:
    """One row for each distinct row of docs: its hashes, doc_id, source, size, source_size, target,
    m (how often it comes), whole (certain copies of each) and extra (how many of the m get one more)."""
    path = scratch(docs.sparkSession)
    rows, hashes = with_row_key(docs)
    weight = F.lit(1.0) if weight_col is None else F.when(F.col(weight_col) > 0, F.col(weight_col).cast("double")).otherwise(F.lit(1.0))
    source = F.col(source_col).cast("string")
    base = rows.select(
        F.col(hashes[0]).alias("h0"), F.col(hashes[1]).alias("h1"), F.col(id_col).cast("long").alias("doc_id"), source.alias("source"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("key"),  # sources by code point, null last
        F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), weight.alias("w"),
    )
    base = base.groupBy(*base.columns).agg(F.count("*").alias("m"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "h0"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    base = stored(base.withColumn("u", u), f"{path}/items")
    sources = stored(_sources(base, weights, share, most, path), f"{path}/sources")
    few = sources.count() <= FEW

    def joined(items: DataFrame, table: DataFrame) -> DataFrame:
        """items, by source, with a stored table that has a row for each source."""
        return items.join(F.broadcast(table), "key") if few else spread_join(items, stored(table.join(sources.select("key", "rows"), "key"), scratch(docs.sparkSession)), ["key"], "rows").drop("rows")

    plain = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    scale = stored(sources.select("key", "source_size", "target", (plain if weight_col is None else F.lit(0.0)).alias("scale")), f"{path}/scale")
    if weight_col is not None:  # documents at the most copies free words for the others, until none is added
        for k in range(40):
            at = joined(base, scale).withColumn("full", F.col("scale") * F.col("w") >= most).withColumn("n", F.col("size") * F.col("m"))
            got = at.groupBy("key").agg(F.sum(F.when(F.col("full"), F.col("n") * most).otherwise(0.0)).alias("fixed"), F.sum(F.when(~F.col("full"), F.col("n") * F.col("w")).otherwise(0.0)).alias("open"))
            better = F.greatest("scale", F.when(F.col("open") > 0, (F.col("target") - F.col("fixed")) / F.col("open")).otherwise(F.col("scale")))
            new = stored(scale.join(got, "key").select("key", "source_size", "target", better.alias("scale"), (better - F.col("scale")).alias("gain")), f"{path}/scale{k}")
            still = new.where(F.col("gain") > 1e-9 * F.greatest(F.lit(1.0), "scale")).count()
            scale = new.drop("gain")
            if not still:
                break
    copies = F.least(F.lit(float(most)), F.col("scale") * F.col("w"))
    rows = joined(base, scale).withColumn("whole", F.floor(copies + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), copies - F.col("whole")))
    # p <= 1e-12 never enters; u and p lie strictly between 0 and 1, so the odds are finite.
    odds = F.when((F.col("p") > 1e-12) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    rows = stored(rows.withColumn("x", odds / (1 + odds)).withColumn("n", F.col("size") * F.col("m")), f"{path}/ranked")
    state = rows.groupBy("key").agg(F.lit(0.0).alias("low"), F.lit(1.0).alias("step"), F.lit(0).cast("long").alias("before"), F.sum(F.col("p") * F.col("n")).alias("wish"))
    state = stored(state, f"{path}/level0")
    # Find, for each source, the bin of the order in which its words run out; then the bin of that bin.
    for k in range(1, LEVELS + 1):
        inside = joined(rows, state).where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("low") + F.col("step")))
        which = F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.col("low")) / F.col("step") * BINS)).cast("int")
        bins = inside.groupBy("key", which.alias("bin")).agg(F.sum("n").alias("n"))
        bins = bins.withColumn("run", F.sum("n").over(Window.partitionBy("key").orderBy("bin"))).join(state, "key").withColumn("end", F.col("run") + F.col("before"))
        cut = bins.where(F.col("end") > F.col("wish")).groupBy("key").agg(F.min_by(F.struct("bin", (F.col("end") - F.col("n")).alias("start")), "bin").alias("c"))
        # Without such a bin every candidate is taken: the cut lies beyond the end.
        last = state.join(cut, "key", "left").select(
            "key", F.when(F.col("c").isNull(), F.col("low") + F.col("step")).otherwise(F.col("low") + F.col("step") * F.col("c.bin") / BINS).alias("low"),
            (F.col("step") / BINS).alias("step"), F.coalesce("c.start", "before").alias("before"), "wish",
        )
        state = stored(last, f"{path}/level{k}")
    rows = joined(rows, state)
    near = (F.col("x") >= F.col("low")) & (F.col("x") < F.col("low") + F.col("step"))
    rows = rows.withColumn("zone", F.when(F.col("x").isNull(), 0).when(F.col("x") < F.col("low"), 1).when(near, 2).otherwise(0))
    order = Window.partitionBy("key").orderBy("x", "size", "doc_id", "h1").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("zone = 2").withColumn("done", F.coalesce(F.sum("n").over(order), F.lit(0)) + F.col("before"))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("m"), F.floor((F.col("wish") - F.col("done")) / F.col("size") + 0.5))).cast("long")).drop("done")
    rest = rows.where("zone <> 2").withColumn("extra", F.col("zone").cast("long") * F.col("m"))
    return rest.unionByName(edge), hashes


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=1.5, most=2.0, seed=17, weight_col=None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row for each input row.

    size counts words of the whole text (null: 0); copies is at most `most` rounded up and whole,
    taken is copies times size. Null sources are one source, ordered last. A source without words
    has target 0 and takes nothing. Rows are ranked by a hash of all their columns, so null and
    repeated ids make no difference; repeated rows are documents of their own. weight_col, if given,
    holds positive document weights (others count as 1). Other columns are read for the hash alone.
    Any number of sources will do. An empty table gives an empty one.
    """
    items, _ = _items(docs, id_col, text_col, source_col, weights, share, most, seed, weight_col)
    each = items.withColumn("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    number = (F.col("whole") + (F.col("r") <= F.col("extra")).cast("long")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", number.alias("copies"), (number * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=1.5, most=2.0, seed=17, weight_col=None) -> DataFrame:
    """docs with each row as many times as mix() takes it; rows without words are left out.

    Rows are told apart by all their columns, so the words written are those that mix() takes,
    whatever ids are null or repeated.
    """
    items, hashes = _items(docs, id_col, text_col, source_col, weights, share, most, seed, weight_col)
    copies, copy = free_name(docs, "_copies"), free_name(docs, "_copy")
    number = F.col("whole") * F.col("m") + F.col("extra")
    taken = items.where(F.col("size") > 0).select(F.col("h0").alias(hashes[0]), F.col("h1").alias(hashes[1]), number.cast("int").alias(copies)).where(F.col(copies) > 0)
    rows, _ = with_row_key(docs)
    rows = rows.dropDuplicates(hashes).join(taken.hint("merge"), hashes)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
