"""Operator 1: mixing sources to target weights by Pareto order sampling.

Every document first gets the whole copies that its source's ratio of target to
size makes certain.  The fractional part is drawn without replacement: documents are
ranked by random odds divided by inclusion odds and the head of that order is
taken until the words reach what the target still lacks, so the sample has a
fixed size in words.  Inclusion odds grow with the square root of a document's
size against its source's mean, hence unequal probabilities.

Plan: one scan counts words into a narrow written table; sums by source are
partial aggregates; the cut in each source's order is found through two levels of
1,024 cells, so no task ever sorts a whole source.  Random numbers come from a
hash of doc_id, so reruns and retried tasks agree.

Defined results: null or blank text has size 0 and is never taken; a null source is a
source of its own, ordered last; a null doc_id is hashed as an empty string; equal
ranks are ordered by doc_id, then size; rows equal in all of these are documents of their own, of which the cut takes as many as
the target still wants, the first by their place in the input; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, written

CELLS = 1024


def _drawn(df: DataFrame, seed: int) -> DataFrame:
    """With u in (0, 1) from doc_id."""
    hexed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    return df.withColumn("u", (F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52)))


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, mean_size, whole, part): water-filling by weight under cap times the source's size.

    Sources in the order of cap to weight: while the level that the rest would get lies above a
    source's cap, that source is capped; the level reached is the largest of these levels.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_full"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    near = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    before = F.coalesce(F.sum("most").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(near.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (total - before) / rest)
    by = by.withColumn("target", F.least(F.col("most"), F.max("level").over(everything) * F.col("weight")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by = by.withColumn("whole", F.floor(ratio).cast("long"))
    by = by.withColumn("part", ratio - F.col("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return by.withColumn("mean_size", F.try_divide("source_size", "n_full")).select("source", "source_size", "target", "mean_size", "whole", "part", "rest")


def _ranked(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with their source's figures and q: random odds over inclusion odds (null: no draw)."""
    t = targets.withColumnRenamed("source", "t_source")
    df = sized.join(t, sized["source"].eqNullSafe(t["t_source"]), "left").drop("t_source")
    odds = F.col("part") / (1 - F.col("part")) * F.sqrt(F.col("size") / F.col("mean_size"))
    return df.withColumn("q", F.when((F.col("size") > 0) & (F.col("part") > 0), F.col("u") / (1 - F.col("u")) / odds))


def _crossing(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """The cell of each source in which the running words pass what is lacking, and the words before it."""
    up = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("upto", F.col("base") + F.sum("words").over(up))
    return run.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))).select("source", *keys, cell, (F.col("upto") - F.col("words")).alias("base"))


def _sized(docs: DataFrame, *columns: str, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return _drawn(docs.select(*columns, size.alias("size")), seed)


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: its target and where its order is cut.  Written, so that Spark knows its size
    and broadcasts it only while that is small."""
    targets = written(source_targets(sized, weights, share, cap), "mix-targets")
    fine = _ranked(sized, targets).where("q is not null")
    even = F.col("q") * F.col("part") / (1 - F.col("part"))  # the odds of u alone but for sizes, whatever the source's part
    spot = even / (1 + even) * CELLS
    fine = fine.withColumn("c1", F.floor(spot)).withColumn("c2", F.floor((spot - F.floor(spot)) * CELLS))
    first = fine.groupBy("source", "c1", "rest").agg(F.sum("size").alias("words")).withColumn("base", F.lit(0))
    one = written(_crossing(first, [], "c1").select(F.col("source").alias("s1"), F.col("c1").alias("k1"), "base"), "mix-cells")
    in_one = fine.join(one, fine["source"].eqNullSafe(one["s1"]) & (fine["c1"] == one["k1"])).drop("s1", "k1")
    second = in_one.groupBy("source", "c1", "c2", "rest", "base").agg(F.sum("size").alias("words"))
    two = _crossing(second, ["c1"], "c2").select(F.col("source").alias("s2"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("base").alias("base2"))
    in_two = in_one.join(two, in_one["source"].eqNullSafe(two["s2"]) & (in_one["c1"] == two["k1"]) & (in_one["c2"] == two["k2"]))
    # Rows of one place count together, so many equal ones are one row here.
    places = in_two.groupBy("source", _place().alias("p"), "rest", "base2").agg(F.count("*").alias("tied"))
    size = F.col("p.size")
    run = Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    near = places.withColumn("before", F.col("base2") + F.sum(F.col("tied") * size).over(run) - F.col("tied") * size)
    # The n-th row of a place is taken if its middle does not pass what is lacking.
    fits = F.floor((F.col("rest") - F.col("before")) / size + 0.5)
    near = near.withColumn("allowed", F.greatest(F.lit(0), F.least(F.col("tied"), fits)))
    # The last place that the mix takes from, and how many rows of it; or else a mark before the first.
    cut = near.groupBy("source").agg(F.max(F.when(F.col("allowed") > 0, F.struct("p", "allowed", "tied"))).alias("top"), F.min("p.q").alias("lowest"))
    cut = cut.select(F.col("source").alias("s1"), F.lit(True).alias("has_cut"), F.col("top.p").alias("last"), F.col("top.allowed").alias("allowed"), F.col("top.tied").alias("tied"), "lowest")
    return written(targets.join(cut, targets["source"].eqNullSafe(cut["s1"]), "left").drop("s1"), "mix-plan")


def _place() -> Column:
    """A document's place in its source's order."""
    return F.struct("q", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "size")


def _copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    split = not plan.where("allowed < tied").isEmpty()
    if split:  # equal rows at a cut are told apart by where they are read
        sized = sized.withColumns({"m_task": F.spark_partition_id(), "m_row": F.monotonically_increasing_id()})
    ranked = _ranked(sized, plan)
    at_cut = F.coalesce((F.col("allowed") < F.col("tied")) & F.col("q").isNotNull() & (_place() == F.col("last")), F.lit(False))
    # Without a crossing the whole order is taken, or none of it where nothing is lacking.
    extra = F.when(F.col("q").isNull(), False).when(F.col("has_cut").isNull(), F.col("rest") > 0).when(F.col("last").isNull(), F.col("q") < F.col("lowest")).otherwise(_place() <= F.col("last"))
    copies = lambda df, more: df.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(F.lit(0).cast("long")))
    if not split:
        return copies(ranked, extra)
    tied = ranked.where(at_cut)
    shares = tied.groupBy("source", "m_task", "allowed").count()
    before = Window.partitionBy("source").orderBy("m_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    shares = written(shares.select(F.col("source").alias("s3"), F.col("m_task").alias("t3"), (F.col("allowed") - F.coalesce(F.sum("count").over(before), F.lit(0))).alias("left")), "mix-ties")
    own = tied.join(shares, tied["source"].eqNullSafe(shares["s3"]) & (tied["m_task"] == shares["t3"]))
    own = own.withColumn("n3", F.row_number().over(Window.partitionBy("source", "m_task").orderBy("m_row")))
    return copies(ranked.where(~at_cut), extra).unionByName(copies(own, F.col("n3") <= F.col("left")).drop("s3", "t3", "left", "n3")).drop("m_task", "m_row")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) of every document.

    weights repeat over the sources in code-point order, null last; share times all words is
    divided by them; no target exceeds cap times its source's words.
    """
    sized = written(_sized(docs, "doc_id", "source", seed=seed), "mix-sizes")
    out = _copies(sized, _plan(sized, weights, share, cap))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns.

    Texts stay where they are: each document is decided by its source's row of the plan.
    """
    sized = written(_sized(docs, "doc_id", "source", seed=seed), "mix-sizes")
    plan = _plan(sized, weights, share, cap)
    whole = F.struct(*[docs[c] for c in docs.columns])
    carried = _sized(docs.select(whole.alias("m_whole"), "doc_id", "source", "text"), "m_whole", "doc_id", "source", seed=seed)
    return _copies(carried, plan).select("m_whole", F.explode(F.expr("if(copies > 0, sequence(1L, copies), array())")).alias("m_copy")).select("m_whole.*")
