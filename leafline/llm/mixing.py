"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its weight's share of all words, stopped at MOST_COPIES times the source, the
excess reshared by weight. A source first takes every document as many whole times as its target
allows; the rest is sampled: documents are ranked by the odds of a random number over the odds of
their inclusion, and the best ranks are taken up to the rest of the target. One last document, the
one that fits the remaining gap best, is added if that comes nearer to the target.

The rank at which a source stops is found from sums over rank ranges, so no task orders a whole
source; only the range in which it stops is ordered.

With tiers (a column of weights of inclusion, of few distinct values a source) documents of a source are
taken unequally: a document's expected copies are its tier's weight times one level for the source, at most
MOST_COPIES, so that the expected words meet the target. Their whole part is certain, and the sample ranks
documents by the odds of what is left.

Defined results: a null text has no words and takes none; a very long one is a number like others. A null
source is a source of its own and sorts last. A null or negative tier counts as 0 and takes nothing. Repeated
rows are documents of their own with equal ranks, of which one at most closes a gap. An empty table gives an
empty table. Random numbers are hashes of doc_id, so reruns agree. Of the input's columns only the
named ones are read; the rest are carried through, and columns named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.llm.common import materialize, n_words_of, table

MOST_COPIES, SEED, RANGES = 3, 7, 8192
CYCLE = 3
#: Up to so many sources their tables are broadcast.
FEW_SOURCES = 20_000


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the key alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def source_targets(sizes: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """sizes: source, source_size, one row for each source. Adds weight and target.

    The level L with sum(min(most_copies * size, L * weight)) = sum(size) is found on the sources in
    order of the level at which each stops.
    """
    everything = Window.partitionBy()
    out = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % CYCLE + 1)
    out = out.withColumns({"__cap": (most_copies * F.col("source_size")).cast("double"), "__all": F.sum("source_size").over(everything).cast("double")})
    by_stop = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    after = by_stop.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = out.withColumns({"__level": level, "__order": F.row_number().over(by_stop)})
    # the first that its level doesn't stop; of those that stop alike the first counts as well
    free = F.col("__level") <= F.col("__cap") / F.col("weight")
    out = out.withColumn("__found", F.min(F.when(free, F.struct("__order", "__level"))).over(everything)["__level"])
    return out.withColumn("target", F.coalesce(F.least(F.col("__cap"), F.col("__found") * F.col("weight")), F.lit(0.0))).drop("__cap", "__all", "__level", "__order", "__found")


def tier_copies(targets: DataFrame, tiers: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """targets: __s, target; tiers: __t (source), __tier, __words. Adds to tiers __expected, the copies of each document of a tier.

    The level L with sum(words * min(most_copies, L * tier)) = target is found on a source's tiers, the largest first:
    those before the found place are taken most_copies times.
    """
    both = tiers.join(targets.select("__s", "target"), F.col("__t").eqNullSafe(F.col("__s"))).drop("__s").where("__tier > 0")
    by = Window.partitionBy("__t").orderBy(F.desc("__tier"))
    full = F.coalesce(F.sum(most_copies * F.col("__words")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum(F.col("__words") * F.col("__tier")).over(by.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("__level", (F.col("target") - full) / F.greatest(weights, F.lit(1e-300)))
    fits = F.when(F.col("__level") * F.col("__tier") <= most_copies, F.struct(-F.col("__tier"), F.col("__level").alias("level")))
    both = both.withColumn("__found", F.min(fits).over(Window.partitionBy("__t"))["level"])
    expected = F.greatest(F.lit(0.0), F.least(F.lit(float(most_copies)), F.coalesce(F.col("__found") * F.col("__tier"), F.lit(float(most_copies)))))
    return both.select("__t", "__tier", "__words", expected.alias("__expected"))


def pareto_mix(df: DataFrame, size_col: str, source_col: str, id_col: str, tier_col: str | None = None, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """Adds source_size, target (its source's), copies and taken (words) to df, which should be a written table.

    tier_col: weights of inclusion within a source, equal if not given.
    """
    df = df.drop("source_size", "target", "copies", "taken")
    own = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    df = df.withColumns({"__size": F.col(size_col).cast("long"), "__source": F.col(source_col)})
    sizes = df.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    targets = source_targets(sizes).drop("weight").withColumnRenamed("source", "__s")
    share = F.col("__rest") / F.greatest(F.col("source_size"), F.lit(1))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    if tier_col is None:
        targets = targets.withColumn("__whole", whole)
        targets = materialize(targets.withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size")).withColumn("__share", share), "targets")
        plan, at = targets, F.col("__source").eqNullSafe(F.col("__s"))
    else:
        targets = materialize(targets, "targets")
        df = df.withColumn("__own", F.greatest(F.coalesce(F.col(tier_col).cast("double"), F.lit(0.0)), F.lit(0.0)))
        tiers = df.groupBy(F.col("__source").alias("__t"), F.col("__own").alias("__tier")).agg(F.sum("__size").alias("__words"))
        tiers = tier_copies(targets, tiers).withColumns({"__whole": F.floor("__expected"), "__share": F.col("__expected") - F.floor("__expected")})
        tiers = tiers.withColumn("__rest", F.sum(F.col("__share") * F.col("__words")).over(Window.partitionBy("__t")))
        plan = materialize(tiers.join(targets, F.col("__t").eqNullSafe(F.col("__s"))).drop("__t", "__words", "__expected"), "tiers")
        at = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__own") == F.col("__tier"))
    # tables with one row for each source are sent to all tasks if their number, counted here, allows
    sent = F.broadcast if plan.count() <= FEW_SOURCES else (lambda x: x)
    rows = df.join(sent(plan), at, "inner" if tier_col is None else "left").drop("__s", "__tier", "__own")
    if tier_col is not None:  # a tier of weight 0 has no row in the plan
        rows = rows.drop("source_size", "target").join(sent(targets), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
        rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("__rest", "__share")} | {"__whole": F.coalesce("__whole", F.lit(0))})
    u = uniform(F.col(id_col), seed)
    share = F.greatest(F.col("__share"), F.lit(1e-12))
    rank = (u / (1 - u)) / (share / (1 - share))
    rows = rows.withColumn("__rank", rank).withColumn("__range", F.floor(F.col("__rank") / (1 + F.col("__rank")) * ranges).cast("int"))
    sampled = rows if tier_col is None else rows.where("__share > 0")
    # words of each rank range of each source: at most ranges rows a source
    sums = sampled.groupBy("__source", "__rest", "__range").agg(F.sum("__size").alias("__words"))
    up_to = F.sum("__words").over(Window.partitionBy("__source").orderBy("__range"))
    # the range in which a source stops, and what comes before it
    stops = sums.withColumn("__up_to", up_to).where(F.col("__up_to") > F.col("__rest")).groupBy("__source").agg(
        F.min(F.struct(F.col("__range").alias("range"), (F.col("__up_to") - F.col("__words")).alias("before"))).alias("__stop")
    ).withColumnRenamed("__source", "__s")
    rows = rows.join(sent(stops), F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
    open_ = F.lit(True) if tier_col is None else F.col("__share") > 0
    inside = F.coalesce(F.col("__range") == F.col("__stop.range"), F.lit(False)) & open_
    below = (F.col("__stop").isNull() | (F.col("__range") < F.col("__stop.range"))) & open_
    clear = rows.where(~inside).withColumn("__sampled", below)
    running = F.sum("__size").over(Window.partitionBy("__source").orderBy("__rank", id_col, "__size").rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.where(inside).withColumn("__sampled", F.col("__stop.before") + running <= F.col("__rest"))
    rows = clear.unionByName(cut).drop("__range", "__stop").withColumns({"__open": ~F.col("__sampled") & open_, "__row": F.monotonically_increasing_id()})
    rows = materialize(rows, "sampled")
    # the document that fills the gap best, if one comes nearer than none
    got = rows.groupBy("__source").agg((F.first("__rest") - F.coalesce(F.sum(F.when(F.col("__sampled"), F.col("__size"))), F.lit(0))).alias("__gap")).withColumnRenamed("__source", "__s")
    off = F.abs(F.col("__size") - F.col("__gap"))
    near = rows.where("__open").join(sent(got), F.col("__source").eqNullSafe(F.col("__s"))).where(off < F.col("__gap"))
    fits = near.groupBy("__source").agg(F.min(F.struct(off.alias("off"), F.col("__rank").alias("rank"), F.col(id_col).alias("id"), own.alias("own"), F.col("__row").alias("row"))).alias("__fit"))
    fits = fits.select(F.col("__source").alias("__s"), F.col("__fit.row").alias("__fit"))
    rows = rows.join(sent(fits), F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
    filled = F.coalesce(F.col("__row") == F.col("__fit"), F.lit(False))
    rows = rows.withColumn("copies", (F.col("__whole") + (F.col("__sampled") | filled).cast("int")).cast("int"))
    rows = rows.withColumn("taken", (F.col("copies") * F.col("__size")).cast("long"))
    return rows.drop("__size", "__source", "__whole", "__rest", "__share", "__rank", "__sampled", "__open", "__row", "__fit")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words_of(F.col("text")).alias("size"))
    out = pareto_mix(materialize(docs, "sizes"), "size", "source", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: The same rows with windows over whole sources.
SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {CYCLE} + 1 AS weight, CAST({MOST_COPIES} * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / weight) AS found FROM l WHERE level <= cap / weight),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, coalesce(least(cap, found * weight), 0.0) AS target FROM l, f),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, t2.* EXCLUDE (source), target - whole * source_size AS rest, greatest((target - whole * source_size) / greatest(source_size, 1), 1e-12) AS share,
  (CAST('0x' || md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:12] AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source),
k AS (SELECT *, (CAST(u AS DOUBLE) / (1 - CAST(u AS DOUBLE))) / (share / (1 - share) * CAST(1.0 AS DOUBLE)) AS rank FROM r),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS sampled FROM k),
g AS (SELECT *, rest - coalesce(sum(CASE WHEN sampled THEN size END) OVER (PARTITION BY source), 0) AS gap FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT sampled AND abs(size - gap) < gap THEN abs(size - gap) END NULLS LAST, rank, doc_id) = 1 AND NOT sampled AND abs(size - gap) < gap AS filled FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE WHEN sampled OR filled THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
