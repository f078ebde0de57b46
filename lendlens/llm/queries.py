"""One registered query per operator, over its whole tables."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm import (
    bpe_codec, decontaminate, divergence, langid, licenses, neardup, prefix_trie, quality, quotes, substrings, token_counts, topk, urlfilter)
from lendlens.sources.tables import materialize, read_table

VOCAB = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048
QUALITY_CUT = 0.7
URL_RULES = [
    urlfilter.Rule("net/", urlfilter.BLOCK), urlfilter.Rule("example.net/en/", urlfilter.ALLOW),
    urlfilter.Rule("example.com/de/", urlfilter.BLOCK), urlfilter.Rule("org/fr/", urlfilter.ALLOW),
]


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text", *more])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a label to learn from, every score is 0.5."""
    docs = _documents(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    learn = langid.training_rows("doc_id")
    try:
        scored = quality.score(docs, quality.fit(docs, labels.where(learn), "quality"))
    except ValueError:  # nothing to learn from
        scored = docs.select("doc_id", F.lit(0.5).alias("score"))
    return scored.select(
        "doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    found = decontaminate.contamination(_documents(spark, sf_dir), items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages", ["page_id", "url"]), URL_RULES, "page_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a label to learn from, every text is ``und``."""
    docs = _documents(spark, sf_dir, "lang")
    learn = langid.training_rows("doc_id")
    try:
        found = langid.identify(docs, langid.fit(docs.where(learn)))
    except ValueError:  # nothing to learn from
        found = langid.unlearned(docs)
    found = found.select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the cut at the limit are read off the stored prefix table."""
    table = token_counts.token_prefixes(_documents(spark, sf_dir), VOCAB)
    table = materialize(table, "prefix-counts", options=token_counts.PACKED)
    found = token_counts.fit_budget(table, TOKEN_LIMIT, keep=["n_bytes", "n_tokens"])
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).where(
        topk.usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    found = topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, "vec_id", "v")
    return found.withColumnRenamed("id", "vec_id")


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    found = quotes.format_conversations(chats, across_gaps=True)
    # lists as text, so that any engine can compare them
    return found.withColumn("unlinked", F.to_json("unlinked")).withColumn("path", F.array_join(F.transform(
        "path", lambda s: F.concat_ws(":", s["at"].cast("string"), s["head"].cast("string"))), "/"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode(_documents(spark, sf_dir), VOCAB, decoded=True)
    return coded.select(
        "row.doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_documents(spark, sf_dir))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first crc32(c) % 4 turns of conversation
    c - c % 20 in place of its own; also (conv), every conversation once.  A
    conversation's rows meet its shift in blocks of their places."""
    block = 4096
    heads = turns.where("depth <= 3").groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "code", "words"))).alias("head"))
    h = (F.crc32(F.col("conv").cast("string")) % 4).cast("int")
    convs = turns.groupBy("conv").agg(F.max("depth").alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    lead = materialize(convs.join(heads, "base", "left").select(
        "conv", "n", "h", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(
            F.array().cast(heads.schema["head"].dataType)).alias("head")), "openings")
    shift = lead.select("conv", "h", (F.size("head") - F.col("h")).alias("shift"),
                        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))).alias("block"))
    rest = turns.withColumn("block", F.floor((F.col("depth") - 1) / block)).join(shift, ["conv", "block"]).where("depth > h") \
        .select("conv", (F.col("depth") + F.col("shift")).alias("depth"), "code", "words")
    opening = lead.select("conv", F.explode("head").alias("t")).select("conv", "t.depth", "t.code", "t.words")
    return materialize(opening.union(rest), "rebuilt"), lead.select("conv")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    nodes = prefix_trie.trie(*rebuilt_turns(prefix_trie.ordered_turns(chats)))
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
                        "n_leaves", F.col("saved_words").alias("saved_tokens"), "ends_sha256")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents", ["text", "lang", "source"]))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir)).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", *[
        F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")], "score")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_exact_topk": op7_exact_topk,
    "op8_quote_links": op8_quote_links,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_license_scan": op13_license_scan,
}

#: DuckDB SQL of the queries that SQL can express (op11 takes crc32 bit by bit).
SQL: dict[str, str] = {
    "op7_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(
    flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END,
    CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)
), turns AS (
  SELECT ids.c, t.i, 0 AS part, role, text FROM ids JOIN t ON t.c = ids.base AND t.i <= h
  UNION ALL SELECT ids.c, t.i, 1, role, text FROM ids JOIN t ON t.c = ids.c AND t.i > h
), placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth,
         concat(length(role), ':', role, text) AS told,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns
), keyed AS (
  SELECT c, depth, words, md5(string_agg(md5(told), ',') OVER (PARTITION BY c ORDER BY depth)) AS k FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM ids
), below AS (
  SELECT k.*, coalesce(lag(k) OVER (PARTITION BY c ORDER BY depth), '') AS up, depth = max(depth) OVER (PARTITION BY c) AS ends FROM keyed k
), nodes AS (
  SELECT k, any_value(depth) AS depth, any_value(up) AS up, any_value(words) AS words, min(c) AS c, count(*) AS n,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ended
  FROM below GROUP BY k
), kids AS (SELECT up AS k, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY up
), spans AS (  -- a node and a node of its subtree, met in the smallest conversation of the lower one
  SELECT a.k, n.k AS low FROM nodes n JOIN below a ON a.c = n.c AND a.depth <= n.depth
), sums AS (
  SELECT s.k, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (kids.kids IS NULL) AS leaves
  FROM spans s JOIN nodes n ON n.k = s.low LEFT JOIN kids ON kids.k = n.k GROUP BY s.k
)
SELECT nodes.c AS conv_id, depth, CASE WHEN depth > 0 THEN (SELECT p.c FROM nodes p WHERE p.k = nodes.up) END AS parent_conv_id,
  n AS n_convs, coalesce(kids.kids, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ended) AS ends_sha256
FROM nodes JOIN sums USING (k) LEFT JOIN kids USING (k)
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(terms) AS term FROM d)
  GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30
), groups AS (SELECT DISTINCT lang, source FROM d
), size AS (
  SELECT g.lang, g.source, coalesce(any_value(k.v), 0) AS v, coalesce(any_value(k.total), 0) AS lang_total, coalesce(sum(c.n), 0) AS total
  FROM groups g LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang) k USING (lang)
    LEFT JOIN (SELECT c.* FROM c JOIN kept USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source
  GROUP BY g.lang, g.source
), share AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (s.total + 5 * s.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // (s.lang_total + 5 * s.v) AS q
  FROM size s JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM share WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 50
""",
}
