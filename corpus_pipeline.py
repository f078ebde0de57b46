"""A corpus pipeline of five stages: ``STAGES`` in order, ``run`` over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet under the shared folder and read again as the next one's docs.
All but the last return the columns they got.

Extra columns are handed through.  A null or empty text is no language and
goes in the first stage; each stage on its own treats it as its operator does.
Documents without an id stay in the near-duplicate stage, and rows repeated
under one id count as copies there: the one with the smallest text stays (of
equal texts the one with the smallest hash of its row).  An empty table stays empty; the first
stage needs at least one labelled text, else it lets all documents pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm import bpe_codec, decontaminate, langid, neardup, substrings
from lendlens.llm.queries import VOCAB
from lendlens.sources.tables import intermediates, materialize, read_table, remove_path

#: A document is rejected if the learned languages together hold less than this
#: share of its letters.
LEAST_SHARE = 0.4
NEAR_WORDS, NEAR_PERCENT = 5, 80
PASSAGE_WORDS = 50
ITEM_WORDS = 10
#: A benchmark item of fewer words condemns a document only if hits hold this
#: share of its words, or if another item is hit too.
SHORT_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language: learned from this table's own labels."""
    try:
        model = langid.fit(docs.where(langid.training_rows("doc_id")))
    except ValueError:  # nothing to learn from
        return docs
    found = langid.identify(docs, model, keep=docs.columns)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("known") >= LEAST_SHARE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group."""
    hashed = [c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    found = neardup.near_duplicates(docs, width=NEAR_WORDS, percent=NEAR_PERCENT)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*hashed)))
    one = docs.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return one.union(docs.where("doc_id is null").select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id has too."""
    found = substrings.remove_repeats(docs, PASSAGE_WORDS, keep=[c for c in docs.columns if c != "text"])
    cut = F.col("n_removed") > 0
    out = {c: F.col("row")[c] for c in docs.columns if c != "text"}
    out["text"] = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut, F.length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars"))
    return found.select(*[out[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item: a full window,
    or shorter items that make up much of the document or are several."""
    items = read_table(spark, sf_dir, "benchmark", ["text"])
    # items of the same words are one item
    plain = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    items = items.select(F.md5(plain).alias("item_id"), "text")
    key = F.md5(F.to_json(F.struct("doc_id", "text")))  # tells rows without id apart too
    found = decontaminate.contamination(docs.select(key.alias("key"), "text"), items, ITEM_WORDS, id_col="key")
    full = F.exists("spans", lambda s: s["stop"] - s["begin"] >= ITEM_WORDS)
    short = (F.col("n_hit") >= SHORT_SHARE * F.col("n_words")) | (F.size("items") > 1)
    bad = found.where((F.col("n_hit") > 0) & (full | short)).select(F.col("key").alias("_key")).distinct()
    return docs.join(bad, key == F.col("_key"), "left_anti").select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to."""
    coded = bpe_codec.encode(docs, VOCAB, keep=["doc_id", "lang", "source"], decoded=True)
    return coded.select("row.*", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL cannot express the language model or the encoder; tests hold each
#: stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; a stage's own tables, and the output of the stage
    before, go when its output is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with intermediates(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            before, done = made.pop(), before  # the output stays
        if done:
            remove_path(spark, done)
    return docs
