"""URL filter: host and path rules, and association rules mined from labelled URLs."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import materialize

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_COUNT = 0.002, 20
# A rule's share of bad URLs, as a multiple of the share among all labelled URLs and in standard errors above that share.
MIN_LIFT, MIN_ERRORS = 1.25, 2.0
# One labelled URL in HELD_OUT is kept from mining, to choose the confidence at which rules decide.
HELD_OUT = 4
BAD = "label=bad"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows; all empty for null and where ``://`` is missing."""
    known = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    after = F.when(known, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"(?s)^[^?#]*(.*)", 1)
    return F.translate(host, UPPER, LOWER), path, rest


def with_parts(urls: DataFrame) -> DataFrame:
    """Rows with ``host, path, rest`` of ``url`` in place of all else but ``page_id, url``."""
    host, path, rest = url_parts(F.col("url"))
    return urls.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"), rest.alias("rest"))


def tokens(host: str = "host", path: str = "path", rest: str = "rest") -> Column:
    """What a URL is made of: host suffixes, path segments by place, file type, query names, fragment.

    Digits become ``0``, so that numbered pages share a token.
    """
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, -i, i), ".")))
    segments = F.transform(
        F.filter(F.split(F.col(path), "/"), lambda s: s != ""), lambda s, i: F.concat(F.lit("path"), i, F.lit("="), F.regexp_replace(s, "[0-9]+", "0"))
    )
    names = F.transform(F.regexp_extract_all(F.col(rest), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda s: F.concat(F.lit("query="), s))
    kind = F.regexp_extract(F.col(path), r"\.([A-Za-z]+)$", 1)
    more = F.array_compact(F.array(F.when(kind != "", F.concat(F.lit("type="), F.lower(kind))), F.when(F.instr(F.col(rest), "#") > 0, F.lit("fragment"))))
    made = F.array_distinct(F.concat(suffixes, segments, names, more))
    return F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(made)


def token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """``token, item, tokens``: tokens in ``least`` or more baskets, those that stand in the same baskets under one item.

    A basket of n tokens that are always seen together would have 2^n frequent
    combinations that all say the same; as one item it has one. Baskets are told
    apart by two hashes of their ids.
    """
    seen = baskets.select("basket", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("count"), *[F.bit_xor(F.xxhash64("basket", F.lit(i))).alias(f"same{i}") for i in (0, 1)]
    )
    frequent = materialize(seen.where(F.col("count") >= least), "tokens")
    classes = frequent.groupBy("count", "same0", "same1").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens"))
    return materialize(frequent.join(classes, ["count", "same0", "same1"]).select("token", "item", "tokens"), "classes")


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, min_errors: float = MIN_ERRORS) -> DataFrame:
    """``items, confidence, support``: token combinations that mark a URL as bad.

    ``labelled`` has ``tokens`` (array) and ``bad`` (boolean); rows where either
    is null are left out. The confidence (share of bad URLs) a rule needs follows
    from the share of bad ones among all: ``min_lift`` times that, and that plus
    ``min_errors`` standard errors of a share among as many URLs. Rules below the
    support (share of all labelled URLs, and ``MIN_COUNT`` of them) or confidence
    are pruned, and so is a rule that says no more than one with a part of its
    tokens. A rule names all tokens that were only ever seen together. Without
    labelled rows, or if none or all are bad, there are no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("bad").isNotNull() & F.col("tokens").isNotNull())
    baskets = materialize(rows.select(F.monotonically_increasing_id().alias("basket"), F.array_distinct("tokens").alias("tokens"), "bad"), "baskets")
    known, bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    if known < MIN_COUNT or bad in (0, known):
        return spark.createDataFrame([], "items array<string>, confidence double, support double")
    least, share = max(min_support * known, MIN_COUNT), bad / known
    classes = token_classes(baskets, math.ceil(least))
    # At most 1 / min_support times a URL's mean number of tokens are frequent, however many URLs there are.
    items = (
        baskets.select("basket", "bad", F.explode_outer("tokens").alias("token"))
        .join(F.broadcast(classes.select("token", "item")), "token", "left")
        .groupBy("basket")
        .agg(F.collect_set("item").alias("items"), F.first("bad").alias("bad"))
        .select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    )
    model = FPGrowth(itemsCol="items", minSupport=least / known, minConfidence=min(1.0, min_lift * share)).fit(materialize(items, "items"))
    found = model.associationRules.where(F.col("consequent")[0] == BAD).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    urls_held = F.col("support") * known / F.col("confidence")
    surely = F.col("confidence") >= share + min_errors * F.sqrt(F.lit(share * (1 - share)) / urls_held)
    rules = materialize(found.where(surely), "rules")
    # A rule is looked up under its parts' own names: all its subsets with one item less.
    parts = rules.select("items", "confidence", F.explode("items").alias("without")).select(
        "items", "confidence", F.array_remove("items", F.col("without")).alias("part")
    )
    shorter = rules.select(F.col("items").alias("part"), F.col("confidence").alias("part_confidence"))
    told = parts.join(shorter, "part").where("part_confidence >= confidence").select("items").distinct()
    kept = rules.join(told, "items", "left_anti")
    spelled = (
        kept.select("items", "confidence", "support", F.explode("items").alias("item"))
        .join(F.broadcast(classes.where("token = item").select("item", "tokens")), "item")
        .groupBy("items", "confidence", "support")
        .agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("spelled"))
    )
    return spelled.select(F.col("spelled").alias("items"), "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, confidence`` of distinct token sets that hold all tokens of a rule.

    The index lists every rule under one of its tokens, the one fewest rules
    have; a set of tokens is held only against rules listed under its own.
    """
    listed = rules.withColumn("rule", F.xxhash64("items"))
    counts = listed.select(F.explode("items").alias("token")).groupBy("token").count()
    index = (
        listed.select("rule", "items", "confidence", F.explode("items").alias("token"))
        .join(counts, "token")
        .groupBy("rule")
        .agg(F.min_by("token", F.struct("count", "token")).alias("token"), F.first("items").alias("items"), F.max("confidence").alias("confidence"))
    )
    sets = urls.select("tokens").distinct()
    return (
        sets.select("tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("items", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max("confidence").alias("confidence"))
    )


def listed_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, listed`` for the longest rule that fits.

    ``rules`` has ``rule`` (like ``example.com/en/``) and ``verdict``. A rule
    fits its host and all subdomains if the path begins with the rule's. Of
    rules as long as each other the first in order of code points wins.
    """
    split = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, locate('/', rule))").alias("start"))
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    return (
        places.select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(split, "suffix")
        .where(F.col("path").startswith(F.col("start")))
        .groupBy("host", "path")
        .agg(F.min(F.struct(-F.length("rule"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("listed"))
    )


def deciding_confidence(labelled: DataFrame, rules: DataFrame) -> float | None:
    """The confidence from which on rules tell bad URLs best, by labelled ones they were not mined from.

    Of all confidences of rules the one at which the share of bad URLs blocked
    exceeds that of good ones by most (the higher one if equal); None if it
    never does, so that rules that are no better than chance decide nothing.
    """
    scored = labelled.join(matched(labelled, rules), "tokens", "left")
    bad, good = scored.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    if not bad or not good:
        return None
    # One row for each confidence that a rule has.
    steps = scored.where("confidence IS NOT NULL").groupBy("confidence").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    down = Window.orderBy(F.desc("confidence"))
    gain = F.sum("bad").over(down) * good - F.sum("good").over(down) * bad
    best = steps.select("confidence", gain.alias("gain")).orderBy(F.desc("gain"), F.desc("confidence")).first()
    return best.confidence if best and best.gain > 0 else None


def judge(urls: DataFrame, rules: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` for every row of ``page_id, url``.

    A listed rule decides first; else the URL is blocked if it holds all tokens
    of a mined rule of at least the deciding confidence, and allowed otherwise;
    ``confidence`` is that of the surest such rule. ``labels`` has ``page_id,
    bad``; rows with null in either teach nothing. A null URL or one without
    ``://`` has an empty host and path, fits no rule and is allowed. Repeated
    rows keep a row each; a table without rows gives none; other columns are
    ignored.
    """
    parsed = with_parts(urls).withColumn("tokens", tokens())
    known = labels.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    held = F.pmod(F.xxhash64("page_id"), F.lit(HELD_OUT)) == 0
    labelled = materialize(parsed.where(F.size("tokens") > 0).join(known, "page_id").select("tokens", "bad", held.alias("held")), "labelled")
    mined = materialize(mined_rules(labelled.where("NOT held"), min_support, min_lift), "mined")
    least = deciding_confidence(labelled.where("held"), mined)
    found = mined.where(F.lit(False) if least is None else F.col("confidence") >= least)
    sure = matched(parsed, found)
    verdict = F.coalesce("listed", F.when(F.col("confidence").isNotNull(), BLOCK).otherwise(ALLOW))
    return (
        parsed.join(listed_rule(parsed, rules), ["host", "path"], "left")
        .join(sure, "tokens", "left")
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
    )
