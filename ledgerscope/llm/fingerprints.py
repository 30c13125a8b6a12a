"""Document fingerprints: an additive hash of the multiset of paragraphs.

Every paragraph (line) is hashed to a wide vector; a document's fingerprint is
the sum of its paragraphs' vectors, lane by lane, modulo a power of two. So it
does not depend on the order of paragraphs, equal documents have equal
fingerprints, and a paragraph is inserted or deleted by adding or subtracting
its vector (``shift``).

The vector has two parts. Eight lanes of 32 bits tell documents apart. The
other lanes say how alike two documents are: a paragraph adds, for each of its
runs of up to 32 characters, the run's hash bits; as signs these lanes are a
random projection of the multiset of runs, so their cosine estimates that of
the multisets, within about 0.1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.tables import NO_ID, key_of, numbered
from ledgerscope.session import materialize

RUN = 32
WIDE_LANES, SIGN_LANES = 8, 96
WORD_BITS = 32


def parts(text: Column, run: int = RUN) -> Column:
    """The paragraphs of a text, marked P, and the runs of all its paragraphs, marked R."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("P"), x))
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"[^\n]{{1,{run}}}"), F.lit(0)), lambda x: F.concat(F.lit("R"), x))
    return F.concat(lines, runs)


def digest_word(digest: str, i: int) -> Column:
    return F.conv(F.substring(F.col(digest), 8 * i + 1, 8), 16, 10).cast("long")


def lanes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``wide`` and ``ones`` (arrays of lane sums) and ``runs``; ``keys`` must be unique."""
    is_run = F.substring("part", 1, 1) == "R"
    hashed = (
        rows.select(*keys, F.explode(parts(F.col(text))).alias("part"))
        .select(*keys, is_run.alias("is_run"), F.md5("part").alias("d"), F.when(~is_run, F.md5(F.concat(F.lit("Q"), "part"))).alias("e"))
        .select(*keys, "is_run", *[digest_word("d", i).alias(f"d{i}") for i in range(4)], *[digest_word("e", i).alias(f"e{i}") for i in range(4)])
    )
    wide = [F.sum(F.when(~F.col("is_run"), F.col(f"{d}{i}"))).alias(f"w{n}") for n, (d, i) in enumerate([(d, i) for d in "de" for i in range(4)])]
    # Two counters to a sum, 32 bits apart.
    signs = []
    for i in range(SIGN_LANES // WORD_BITS):
        for bit in range(WORD_BITS // 2):
            low = F.shiftright(f"d{i}", bit).bitwiseAND(F.lit(1))
            high = F.shiftright(f"d{i}", bit + WORD_BITS // 2).bitwiseAND(F.lit(1))
            signs.append(F.sum(F.when(F.col("is_run"), low + F.shiftleft(high, 32))).alias(f"s{i}_{bit}"))
    sums = hashed.groupBy(*keys).agg(*wide, *signs, F.count_if("is_run").alias("runs"))
    mask = F.lit((1 << 32) - 1)
    wide_lanes = [F.col(f"w{n}").bitwiseAND(mask) for n in range(WIDE_LANES)]
    halves = [F.coalesce(f"s{i}_{bit}", F.lit(0)) for i in range(SIGN_LANES // WORD_BITS) for bit in range(WORD_BITS // 2)]
    ones = [h.bitwiseAND(mask) for h in halves] + [F.shiftright(h, 32) for h in halves]
    # No text has 2^31 runs.
    return sums.select(*keys, F.array(*wide_lanes).alias("wide"), F.array(*ones).cast("array<int>").alias("ones"), "runs")


def shift(a: Column, b: Column, sign: int = 1, bits: int = 32) -> Column:
    """Lanes ``a`` after inserting (or, with sign -1, deleting) paragraphs whose lanes sum to ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << bits)))


def reduced(x: Column) -> Column:
    """A lane as it is printed: modulo 2^32."""
    return F.pmod(x, F.lit(1 << 32))


def fingerprint(p: str) -> Column:
    """All lanes and the number of runs of a prefix of columns ``wide, ones, runs``, each modulo 2^32 in four bytes, as base64."""
    values = F.concat(F.col(f"{p}wide"), F.col(f"{p}ones"), F.array(F.col(f"{p}runs")))
    digits = F.array_join(F.transform(values, lambda x: F.lpad(F.hex(reduced(x)), 8, "0")), "")
    return F.translate(F.base64(F.unhex(digits)), "\r\n", "")


def likeness(a: str, b: str) -> Column:
    """0 to 1 for the fingerprints of two prefixes of columns, from what they print; 1 for equal ones."""
    signed = lambda p: F.transform(F.col(f"{p}ones"), lambda x: 2 * reduced(x) - reduced(F.col(f"{p}runs")))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v)
    left, right = signed(a), signed(b)
    size = F.sqrt(dot(left, left).cast("double")) * F.sqrt(dot(right, right).cast("double"))
    cosine = F.when(size > 0, dot(left, right) / size).otherwise(0.0)
    same = fingerprint(a) == fingerprint(b)
    return F.when(same, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), 6))


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for every row; a null text counts as empty (one empty paragraph).

    Repeated rows keep a row each; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return lanes(rows, ["row", "doc_id", "n_chars"], "text").select("doc_id", "n_chars", fingerprint("").alias("fingerprint"))


def next_ids(docs: DataFrame) -> DataFrame:
    """``key, next_key, half``: for each id the one after it, descending, the last followed by the first.

    ``half`` is the greatest number of characters any document of the id needs of its successor.
    """
    halves = docs.groupBy("key").agg(F.max(F.floor(F.length("text") / 2)).alias("half"))
    ranks = materialize(numbered(halves, F.col("key").desc(), name="rank"), "ids")
    after = ranks.select(F.col("key").alias("next_key"), F.col("rank").alias("next_rank"))
    wrapped = F.when(F.col("rank") == F.lit(ranks.count()), 1).otherwise(F.col("rank") + 1)
    return ranks.withColumn("next_rank", wrapped).join(after, "next_rank").select("key", "next_key", "half")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, of an edit of each, and how alike they and its successor's are.

    The edit replaces the last ``floor(n_chars / 2)`` characters by the first
    as many of the document with the next smaller ``doc_id`` (after the last
    the first; a null id comes last). Where an id repeats, its text with the
    smallest SHA-256 is the one that others refer to. A null text counts as
    empty; repeated rows keep a row each; a table without rows gives none;
    other columns are ignored.
    """
    # Both joins read the same two columns by the same key, so the texts are shuffled once.
    texts = docs.select(key_of("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    links = materialize(next_ids(texts), "next-ids")
    offered = (
        texts.join(links.select(F.col("next_key").alias("key"), F.col("key").alias("owner"), "half"), "key")
        .select(F.col("owner").alias("key"), F.expr("substring(text, 1, cast(half as int))").alias("offer"), F.sha2("text", 256).alias("sha"))
        .groupBy("key")
        .agg(F.min_by("offer", "sha").alias("offer"))
    )
    edited = texts.join(offered, "key").withColumn("n_chars", F.length("text").cast("long"))
    edited = edited.withColumn("doc_id", F.when(F.col("key") != NO_ID, F.col("key")))
    edited = edited.withColumn(
        "edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(offer, 1, cast(n_chars div 2 as int)))")
    )
    both = edited.withColumn("row", F.monotonically_increasing_id()).select(
        "row",
        "key",
        "doc_id",
        "n_chars",
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v"),
    )
    keys = ["key", "row", "doc_id", "n_chars"]
    # 32 bytes travel with each of the two texts.
    versions = both.select(*keys, "v.which", "v.text", F.unhex(F.sha2("v.text", 256)).alias("sha"))
    made = lanes(versions, [*keys, "which", "sha"], "text")
    pair = [F.max(F.when(F.col("which") == w, F.struct("wide", "ones", "runs", "sha"))).alias(n) for w, n in ((0, "own"), (1, "edit"))]
    done = materialize(made.groupBy(*keys).agg(*pair), "fingerprints")
    after = done.groupBy(F.col("key").alias("next_key")).agg(F.min_by("own", "own.sha").alias("next"))
    return (
        done.join(links.select("key", "next_key"), "key")
        .join(after, "next_key")
        .select(
            "doc_id",
            "n_chars",
            F.lower(F.hex("edit.sha")).alias("edited_sha256"),
            fingerprint("own.").alias("fingerprint"),
            fingerprint("edit.").alias("edited_fingerprint"),
            likeness("own.", "edit.").alias("near_edited"),
            likeness("own.", "next.").alias("near_next"),
        )
    )
