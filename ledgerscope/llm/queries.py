"""The operators of this subpackage, bound to a directory of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import chats, decontamination, fingerprints, langid, mixing, neardups, ngrams, passages, periodic, quality, search, toxicity, urls
from ledgerscope.llm.samples import split_number
from ledgerscope.llm.tables import WORD, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark, sf_dir):
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


@query
def op3_passages(spark, sf_dir):
    return passages.repeats(read(spark, sf_dir, "documents")).drop("version")


@query
def op4_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.graded(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


@query
def op5_mixing(spark, sf_dir):
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op6_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = split_number(F.col("doc_id"), 4) == 2
    ranking = quality.learn(docs, read(spark, sf_dir, "labels").where(~held_out))
    scored = quality.scored(docs, ranking, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op7_lm_scores(spark, sf_dir):
    held_out = split_number(F.col("doc_id"), 5) == 1
    found = ngrams.scores(read(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train")))
    return found.withColumn("held_out", held_out)


@query
def op8_neardups(spark, sf_dir):
    return neardups.near_duplicates(read(spark, sf_dir, "documents"), neardups.Settings(shingle=2)).drop("class_id")


@query
def op9_url_rules(spark, sf_dir):
    """Pages are labelled through the document that their URL numbers: bad where its quality is 0 or it is toxic."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("url", r"/([0-9]+)[^/]*/?$", 1)
    of_document = pages.select("page_id", F.when(number != "", number).try_cast("long").alias("doc_id"))
    labels = read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge(pages, rules, of_document.join(labels, "doc_id").select("page_id", "bad"))


@query
def op10_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = split_number(F.col("doc_id"), 5) == 0
    model = langid.learn(docs.select("doc_id", "text", "lang").where(~held_out))
    found = langid.identified(docs, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def with_cycles(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; one text in ten goes in a cycle of its own words from some word on, as the contract sets out."""
    checksum = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.expr("_h div 10")
    words = docs.select("doc_id", "text", checksum.alias("_h")).select(
        "doc_id", "text", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("_words"), g.alias("_g")
    )
    n = F.size("_words")
    sized = words.where("size(_words) > 0").withColumn("_a", (F.col("_g") % n).cast("int"))
    sized = sized.withColumn("_p", F.expr("cast(1 + (size(_words) - _a) div (3 + _g % 8) as int)"))
    cycle = F.expr("slice(_words, _a + 1, _p)")
    times = F.expr("cast(ceil((size(_words) - _a) / _p) as int)")
    tail = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), n - F.col("_a"))
    edited = sized.select("doc_id", F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ").alias("text"))
    return words.where("_words IS NULL OR size(_words) <= 0").select("doc_id", "text").unionByName(edited)


@query
def op11_runs(spark, sf_dir):
    found = periodic.periodic_runs(with_cycles(read(spark, sf_dir, "documents")), exponent=4, least_words=6)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query
def op12_chats(spark, sf_dir):
    """Digests are taken from what the formatted conversations and their loss masks say."""
    control = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", control), (-1, 1, "assistant", control)]
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    template = chats.Template()
    made = chats.conversations(chats.chains(turns.unionByName(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), template)
    back = made.select("tree_id", "formatted", template.turns(F.col("formatted")).alias("turns"), chats.loss_text(F.col("segments")).alias("learned"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op13_search(spark, sf_dir):
    return search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
