"""Mix sources to target weights by capped water-filling, then sample repetitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.tables import WORD, numbered
from ledgerscope.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix"
# Documents of a source are ordered by a hash of 48 bits; this many bits of it make the bins of the first pass.
HASH_BITS, BIN_BITS = 48, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A seeded number of 48 bits for a document."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources by code point, null last, take the weights in turn. The budget is
    ``share`` of all words; a source is clamped at ``max_epochs`` times its
    size and what it leaves is shared out by weight until none is above.
    An empty source has target 0. The level is found with a few sums over the
    table of sources, which are never gathered in one place.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranks = numbered(per_source, F.col("source").asc_nulls_last(), name="rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    table = materialize(
        ranks.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(max_epochs))), "sources"
    )
    budget = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = -1.0, -1
    while True:
        full = F.col("limit") <= F.lit(level) * F.col("weight")
        taken, free, count = table.agg(
            F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)
        ).first()
        if count == clamped:  # nobody else went over the limit
            break
        clamped = count
        if not free:
            level = math.inf
            break
        level = (budget - taken) / free
    target = F.col("limit") if math.isinf(level) else F.least("limit", F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def repetitions(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """How to repeat the documents of each source (rows of ``source, size, draw``) so that it comes near its target.

    Each document is taken as often as whole epochs fit; of the rest, documents
    are taken once more in the order of a seeded hash up to the point nearest
    the target, and then the one document is added or left out that brings it
    nearest. Documents with equal hash are taken together or not at all.
    The point is found in bins of hash values first and then inside one bin,
    so no task sorts a whole source.
    """
    plan = targets.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    binned = sizes.withColumn("bin", F.shiftright("draw", HASH_BITS - BIN_BITS))
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    running = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))
    edge = (
        bins.withColumn("upto", running)
        .join(plan.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source")))
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("bin_size") <= F.col("rest")))
        .select(F.col("source").alias("e_source"), F.col("bin").alias("e_bin"), (F.col("upto") - F.col("bin_size")).alias("below"), "rest")
    )
    inside = (
        binned.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bin") == F.col("e_bin")))
        .groupBy("source", "draw", "below", "rest", "bin")
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("draw")))
    )
    fits = F.col("upto") - F.col("size") / 2 <= F.col("rest")
    start = F.shiftleft("bin", HASH_BITS - BIN_BITS) - 1
    last = inside.groupBy(F.col("source").alias("l_source")).agg(
        F.max(F.when(fits, F.col("draw")).otherwise(start)).alias("last"),
        F.max(F.when(fits, F.col("upto")).otherwise(F.col("below"))).alias("reached"),
    )
    plan = materialize(
        plan.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left").select(
            F.col("source").alias("p_source"),
            "source_size",
            "target",
            "whole",
            F.coalesce("last", F.lit(-1)).alias("last"),
            (F.col("rest") - F.coalesce("reached", F.lit(0))).alias("gap"),
        ),
        "mix-plan",
    )
    in_source = F.col("source").eqNullSafe(F.col("p_source"))
    # One more document, or one less, where that brings the source nearer.
    left = F.when((F.col("gap") > 0) & (F.col("draw") > F.col("last")), F.abs(F.col("gap") - F.col("size"))).when(
        (F.col("gap") < 0) & (F.col("draw") <= F.col("last")), F.abs(F.col("gap") + F.col("size"))
    )
    swaps = (
        sizes.join(plan, in_source)
        .withColumn("left", left)
        .where(F.col("left") < F.abs("gap"))
        .groupBy(F.col("source").alias("s_source"))
        .agg(F.min_by("draw", F.struct("left", "draw")).alias("swap"))
    )
    return materialize(plan.join(swaps, F.col("p_source").eqNullSafe(F.col("s_source")), "left").drop("s_source"), "mix-plan")

def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``source, draw`` and others with ``source_size, target, copies``."""
    again = (F.col("draw") <= F.col("last")) != F.coalesce(F.col("draw") == F.col("swap"), F.lit(False))
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
        .withColumn("copies", F.col("whole") + again.cast("long"))
        .drop("p_source", "whole", "last", "gap", "swap")
    )


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("draw")), "sizes"
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """How often each document goes into the mix.

    Rows of ``doc_id, source, size, source_size, target, copies, taken``: one
    per document. A null or empty text has size 0 and takes 0 words whatever
    its copies. Repeated ids draw the same number, so they are taken alike.
    A table without rows gives none; other columns of ``docs`` are ignored.
    """
    sizes = sized(docs, seed)
    plan = repetitions(sizes, source_targets(sizes, weights, share, max_epochs))
    return with_copies(sizes, plan).withColumn("taken", F.col("size") * F.col("copies")).drop("draw")


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, numbered by ``epoch`` from 1.

    Keeps the columns of ``docs`` (but for one that is called ``epoch``);
    documents that are not taken are left out.
    """
    docs = docs.drop("epoch")
    sizes = sized(docs, seed)
    plan = repetitions(sizes, source_targets(sizes, weights, share, max_epochs))
    drawn = docs.select(F.struct(*docs.columns).alias("doc"), "source", draw(F.col("doc_id"), seed).alias("draw"))
    taken = with_copies(drawn, plan).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("epoch")).select("doc.*", "epoch")
