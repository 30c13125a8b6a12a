"""MinHash near-duplicates: an inverted join of signature coordinates.

Documents with equal shingle sets are one class. A class is posted under each
pair of a coordinate and its value. Two classes with at least ``matches`` equal
coordinates share a pair even among the ``coordinates - matches + 1`` rarest of
each (prefix), so only those are posted and frequent pairs are skipped. The
collisions of the other coordinates are counted where two classes meet, on one
bit of each. Candidates that pass are counted again on many more bits, and what
is left is confirmed on the full shingle sets.

Classes that meet are first held against one of a few of them only: of some that are
typical (whose pairs are the most frequent) the one with the most equal bits. Nearly all of a large group of near copies is linked that way.

What is left are classes of different components that meet. In small groups all
are held against each other. Large groups are joined by the rarest shingles of
their full sets. Two linked sets have so many shingles in common that the first
common one, in any fixed order, comes early in either; how early depends on both
sizes. The order begins with shingles that few of the classes outside the largest
components have, so that a class with too many shingles of its own meets nobody,
however large its group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.tables import components, key_of, only, small_to_all
from ledgerscope.llm.words import U64, Words, mix, pieces, seeds
from ledgerscope.session import materialize


@dataclass(frozen=True)
class Settings:
    """``percent`` is the least similarity.

    At 80 %, 26 of 48 equal coordinates, 155 of 192 and 881 of 1024 equal bits
    miss about one pair in 10^5 each; the first are the posted coordinates, and
    unequal coordinates have equal bits half of the time.
    """

    shingle: int = 5
    percent: int = 80
    coordinates: int = 48
    matches: int = 26
    bits: int = 192
    equal_bits: int = 155
    sketch: int = 1024
    equal_sketch: int = 881
    # Pairs of a class under which it is held against the centres.
    star_pairs: int = 2
    centres: int = 6
    # Groups of a pair in which classes meet more than this many others on average are large.
    meetings_per_posting: int = 500
    # Rounds of centres go on while there are large groups and links found are more than this many for each posting.
    star_share: float = 0.0001
    star_rounds: int = 6

    @property
    def least_linked(self) -> int:
        """Smaller sets are linked with equal ones only."""
        return -(-self.percent // (100 - self.percent))


def shingle_sets(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where those of each begin."""
    hashes, first = Words(column).shingles(shingle)
    hashes = hashes.copy()
    for a, b in zip(first[:-1], first[1:]):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[first[:-1][first[:-1] < len(hashes)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return hashes[fresh], kept[first]


def set_ids(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that tell sets apart; 0 for empty ones."""
    full = np.flatnonzero(first[1:] > first[:-1])
    out = np.zeros((2, len(first) - 1), U64)
    if len(full):
        at = first[:-1][full]
        out[0, full] = np.add.reduceat(mix(sets + U64(1)), at)
        out[1, full] = np.bitwise_xor.reduceat(mix(sets * U64(0x9E3779B97F4A7C15)), at)
    return out[0].view(np.int64), out[1].view(np.int64)


def least_values(sets: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The least hash of every non-empty set under each of ``n`` hash functions (32 bits)."""
    begin = first[:-1][np.diff(first) > 0]
    for factor in seeds(n, 9000) if len(begin) else []:
        yield np.minimum.reduceat(sets * factor, begin) >> U64(32)


def lists(rows: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """A list for each size: empty where it is 0, else the next of the rows."""
    offsets = np.concatenate([[0], np.cumsum((sizes > 0) * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, signature, bits`` for every row (empty lists for empty sets).

    ``bits`` packs the lowest bit of every coordinate, also of those that are not posted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets, first = shingle_sets(part.column("text"), settings.shingle)
                a, b = set_ids(sets, first)
                sizes = np.diff(first)
                full = int(np.count_nonzero(sizes))
                values = np.zeros((full, settings.coordinates), np.int32)
                bits = np.zeros((full, settings.bits // 64), U64)
                for k, least in enumerate(least_values(sets, first, settings.bits)):
                    bits[:, k // 64] |= (least & U64(1)) << U64(k % 64)
                    if k < settings.coordinates:
                        values[:, k] = least.astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(a), pa.array(b), lists(values, sizes), lists(bits.view(np.int64), sizes)],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signature", "bits"],
                )

    schema = "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>, bits array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def postings(classes: DataFrame, settings: Settings) -> DataFrame:
    """``pair, place, class_id, size, bits, typical``: every class under its rarest coordinate-value pairs.

    ``place`` counts from the most frequent of them, 0 on. Rows with a place
    below 0 are the most frequent pairs of all, under which centres are found.
    """
    pairs = classes.where(F.col("size") >= settings.least_linked).select("class_id", F.posexplode("signature").alias("at", "value"))
    pairs = pairs.select("class_id", F.xxhash64("at", "value").alias("pair"))
    shared = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    ranked = (
        pairs.join(shared, "pair")
        .groupBy("class_id")
        .agg(F.sort_array(F.collect_list(F.struct("times", "pair"))).alias("pairs"), F.sum("times").alias("typical"))
    )
    # Pairs that occur once come before all others in the prefix and need no posting.
    prefix = F.size("pairs") - (settings.matches - 1)
    often = F.slice("pairs", -settings.star_pairs, settings.star_pairs)
    return (
        ranked.where(prefix > 0)
        .join(classes.select("class_id", "size", "bits"), "class_id")
        .select("class_id", "size", "bits", "typical", F.posexplode(F.concat(often, F.reverse(F.slice("pairs", F.lit(1), prefix)))).alias("place", "p"))
        .select(F.col("p.pair").alias("pair"), (F.col("place") - settings.star_pairs).alias("place"), "class_id", "size", "bits", "typical")
    )


def unequal_bits(settings: Settings) -> Column:
    """In how many bits two classes that meet (one with ``other_`` columns) differ."""
    return sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("other_bits")[i])) for i in range(settings.bits // 64)), F.lit(0))


def may_link(settings: Settings) -> Column:
    """Whether two classes that meet (one with ``other_`` columns) are alike in size and have enough equal bits."""
    sizes = F.least("size", "other_size") * 100 >= F.greatest("size", "other_size") * settings.percent
    return sizes & (unequal_bits(settings) <= settings.bits - settings.equal_bits)


def class_texts(docs: DataFrame, classes: DataFrame, index: DataFrame, settings: Settings) -> DataFrame:
    """``class_id, text, sketch`` of the classes that meet another one; the sketch has one bit of many more coordinates."""
    meet = index.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pair")
    ids = index.join(meet, "pair", "left_semi").select("class_id").distinct()
    wanted = classes.select("class_id", key_of("doc_id").alias("key"), F.col("set_a").alias("wanted_set")).join(ids, "class_id", "left_semi")
    wanted = small_to_all(materialize(wanted, "meeting-classes"))
    rows = docs.select(key_of("doc_id").alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets, first = shingle_sets(part.column("text"), settings.shingle)
                sizes = np.diff(first)
                bits = np.zeros((int(np.count_nonzero(sizes)), settings.sketch // 64), U64)
                for k, least in enumerate(least_values(sets, first, settings.sketch)):
                    bits[:, k // 64] |= (least & U64(1)) << U64(k % 64)
                # A class is looked up by the id of one document; where ids repeat, texts of other classes come along.
                own = pa.array(set_ids(sets, first)[0] == part.column("wanted_set").to_numpy())
                out = [part.column("class_id"), part.column("text"), lists(bits.view(np.int64), sizes)]
                yield pa.RecordBatch.from_arrays(out, ["class_id", "text", "sketch"]).filter(own)

    found = rows.join(wanted, "key").select("class_id", "wanted_set", "text")
    return materialize(found.mapInArrow(run, "class_id long, text string, sketch array<long>"), "class-texts")


def counted(candidates: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Candidate pairs ``a, b`` whose sketches have enough equal bits."""
    mine = texts.select(F.col("class_id").alias("a"), F.col("sketch").alias("sketch_a"))
    other = texts.select(F.col("class_id").alias("b"), F.col("sketch").alias("sketch_b"))
    unequal = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    met = candidates.select("a", "b").distinct().join(mine, "a").join(other, "b")
    return met.where(unequal <= settings.sketch - settings.equal_sketch).select("a", "b")


def confirmed(candidates: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Candidate pairs whose full shingle sets are similar enough, as ``a, b``."""
    # Texts move once for each pair and once for each class that is in one.
    candidates = materialize(candidates, "candidates")
    ids = materialize(candidates.select(F.col("b").alias("class_id")).distinct(), "candidate-ids")
    mine = texts.select(F.col("class_id").alias("a"), F.col("text").alias("text_a")).join(small_to_all(candidates), "a")
    other = only(texts, ids, "class_id").select(F.col("class_id").alias("b"), F.col("text").alias("text_b"))
    joined = mine.join(other, "b").select("a", "text_a", "b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text_a"):
                left, at = shingle_sets(part.column("text_a"), settings.shingle)
                right, by = shingle_sets(part.column("text_b"), settings.shingle)
                good = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = left[at[i] : at[i + 1]], right[by[i] : by[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = 100 * both >= settings.percent * (len(x) + len(y) - both)
                yield part.select(["a", "b"]).filter(pa.array(good))

    return joined.mapInArrow(run, "a long, b long")


def against_centres(index: DataFrame, round_: int, settings: Settings) -> DataFrame:
    """Candidates ``a, b``: each class with the likest centre, outside its component, of the most frequent pairs it has and is posted under."""
    posts = F.sort_array(F.collect_list(F.struct("place", "pair")))
    few = index.groupBy("class_id").agg(
        *[F.first(c).alias(c) for c in ("size", "bits", "typical", "component")], F.slice(posts, 1, 2 * settings.star_pairs).alias("posts")
    )
    few = few.select("class_id", "size", "bits", "typical", "component", F.explode("posts.pair").alias("pair"))
    one = F.struct(
        F.col("class_id").alias("b"), F.col("size").alias("other_size"), F.col("bits").alias("other_bits"), F.col("component").alias("other_component")
    )
    # The most typical one of each of several random parts: others in every round, but near the middle of the group.
    part = F.pmod(F.xxhash64("class_id", F.lit(round_)), F.lit(settings.centres))
    picks = [F.max_by(one, F.when(part == k, F.struct("typical", "class_id"))) for k in range(settings.centres)]
    centres = few.groupBy("pair").agg(F.array(*picks).alias("centres"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = few.withColumnRenamed("class_id", "a").join(centres.select("pair", "centres"), "pair")
    met = star.select("a", "size", "bits", "component", F.inline("centres")).where((F.col("component") != F.col("other_component")) & may_link(settings))
    return met.groupBy("a").agg(F.min_by("b", F.struct(unequal_bits(settings), "b")).alias("b"))


def across_small_groups(index: DataFrame, settings: Settings) -> DataFrame:
    """Candidates ``a, b``: classes of different components that meet, each once, under the least of their common pairs.

    For groups of bounded size: everyone in a group is held against all others.
    """
    mine = index.groupBy("class_id").agg(
        F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("component").alias("component"), F.sort_array(F.collect_set("pair")).alias("pairs")
    )
    under = mine.select("class_id", "size", "bits", "component", "pairs", F.posexplode("pairs").alias("at", "pair"))
    under = under.select("pair", "class_id", "size", "bits", "component", F.slice("pairs", F.lit(1), F.col("at")).alias("before"))
    left = under.withColumnRenamed("class_id", "a")
    right = under.select(
        F.col("pair").alias("other_pair"),
        F.col("class_id").alias("b"),
        F.col("size").alias("other_size"),
        F.col("bits").alias("other_bits"),
        F.col("component").alias("other_component"),
        F.col("before").alias("other_before"),
    )
    apart = (F.col("a") < F.col("b")) & (F.col("component") != F.col("other_component"))
    first = ~F.arrays_overlap("before", "other_before")
    return left.join(right, (F.col("pair") == F.col("other_pair")) & apart & may_link(settings) & first).select("a", "b")


def outside_largest(index: DataFrame, settings: Settings) -> DataFrame:
    """``class_id, least_other``: classes that meet a larger component, with the least size (or a little less) of those they meet.

    Of two classes of different components that meet one at least is told.
    """
    members = index.select("component", "class_id").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    rows = index.join(members, "component")
    rough = F.col("size") - F.col("size") % F.greatest(F.lit(1), F.floor(F.col("size") / 64))
    groups = rows.groupBy("pair").agg(F.max(F.struct("members", "component")).alias("largest"), F.collect_set(rough).alias("sizes"))
    smallest = F.ceil(F.col("size") * settings.percent / 100) * 63 / 64
    met = rows.join(groups, "pair").where(F.col("component") != F.col("largest.component"))
    near = F.array_min(F.filter("sizes", lambda s: s >= F.floor(smallest)))
    return met.groupBy("class_id").agg(F.min(near).alias("least_other"))


def set_rows(texts: DataFrame, settings: Settings) -> DataFrame:
    """``class_id, shingle``: the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets, first = shingle_sets(part.column("text"), settings.shingle)
                ids = np.repeat(part.column("class_id").to_numpy(), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sets.view(np.int64))], ["class_id", "shingle"])

    return texts.select("class_id", "text").mapInArrow(run, "class_id long, shingle long")


def across_large_groups(index: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Candidates ``a, b``: classes of different components that have one of the shingles in common by which linked ones must meet."""
    open_ = index.groupBy("class_id").agg(*[F.first(c).alias(c) for c in ("size", "bits", "component")])
    open_ = materialize(open_.join(outside_largest(index, settings), "class_id", "left"), "open-classes")
    outside = open_.where("least_other is not null")
    found = set_rows(texts.join(outside.select("class_id"), "class_id", "left_semi"), settings)
    times = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    # As many shingles of a set come before the one at ``at`` in the order of all; what two sets have in common lies behind it in both.
    at = F.row_number().over(Window.partitionBy("class_id").orderBy("times", "shingle")) - 1

    def early(other: str) -> Column:
        return (F.col("size") - F.col("at")) * (100 + settings.percent) >= (F.col("size") + F.col(other)) * settings.percent

    placed = found.join(times, "shingle").select("class_id", "shingle", at.alias("at")).join(outside, "class_id").where(early("least_other"))
    placed = materialize(placed.select("shingle", F.col("class_id").alias("a"), "size", "bits", "component", "at"), "early-shingles")
    keys = materialize(placed.select("shingle").distinct(), "early-keys")
    others = only(set_rows(texts.join(open_.select("class_id"), "class_id", "left_semi"), settings), keys, "shingle")
    others = others.join(open_, "class_id").select(
        "shingle",
        F.col("class_id").alias("b"),
        F.col("size").alias("other_size"),
        F.col("bits").alias("other_bits"),
        F.col("component").alias("other_component"),
    )
    apart = (F.col("component") != F.col("other_component")) & early("other_size") & may_link(settings)
    met = placed.join(others.withColumnRenamed("shingle", "other_shingle"), (F.col("shingle") == F.col("other_shingle")) & apart)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked_classes(docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """``class_id, component`` for every class that has a link to another one."""
    index = materialize(postings(classes, settings), "postings").withColumn("component", F.col("class_id"))
    texts = class_texts(docs, classes, index.where("place >= 0"), settings)

    def links(candidates: DataFrame) -> DataFrame:
        return materialize(confirmed(counted(candidates, texts, settings), texts, settings), "links")

    edges = None
    for round_ in range(settings.star_rounds):
        new = links(against_centres(index, round_, settings))
        found = new.count()
        edges = new if edges is None else edges.unionByName(new)
        labels = components(edges).withColumnRenamed("node", "class_id")
        # The members of one component need not meet again.
        rest = index.drop("component", "n").join(labels, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        rest = rest.where("place >= 0")
        met = rest.groupBy("pair").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
        index = materialize(rest.join(met.where("low <> high").select("pair", "n"), "pair"), "open-postings")
        large = (F.col("n") - 1) / 2 > settings.meetings_per_posting
        rows, many = index.agg(F.count(F.lit(1)), F.count_if(large)).first()
        edges = labels.select(F.col("class_id").alias("a"), F.col("component").alias("b"))
        if not rows:
            return labels
        if not many or found <= settings.star_share * rows:
            break
    candidates = across_small_groups(index.where(~large), settings)
    if many:
        candidates = candidates.unionByName(across_large_groups(index.where(large), texts, settings))
    return components(edges.unionByName(links(candidates))).withColumnRenamed("node", "class_id")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id`` for every row of ``doc_id, text``.

    Documents are linked if their sets of word shingles have at least
    ``percent`` of their union in common. ``component_id`` is the smallest id
    reachable over links (null ids count as none, and only a group without any
    id has null); the document with that id is kept. A text of fewer words than
    a shingle is one shingle; a null or blank text has none, is linked with
    nothing and kept. Repeated rows fall into one group and keep a row each.
    Other columns are ignored; a table without rows gives none.
    """
    signed = materialize(signatures(docs, settings), "signatures").withColumn("class_id", F.xxhash64("n_shingles", "set_a", "set_b"))
    classes = signed.where("n_shingles > 0").groupBy("class_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("set_a").alias("set_a"), F.first("signature").alias("signature"), F.first("bits").alias("bits")
    )
    classes = materialize(classes, "classes")
    labels = linked_classes(docs, classes, settings)
    grouped = classes.select("class_id", "doc_id").join(labels, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = materialize(grouped.join(least, "component").select("class_id", "component_id"), "class-components")
    rows = signed.select("doc_id", "n_shingles", "class_id").join(of_class, "class_id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class_id")


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns.

    A row that repeats a kept document stays once. Rows without an id cannot be
    told apart and all stay.
    """
    kept = near_duplicates(docs, settings).where("kept and doc_id is not null").groupBy("doc_id").count()
    kept = materialize(kept, "kept-ids")
    once = only(docs, kept.where("count = 1").select("doc_id"), "doc_id")
    again = only(docs, kept.where("count > 1").select("doc_id"), "doc_id").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))
