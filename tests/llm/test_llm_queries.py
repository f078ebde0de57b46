"""Every registered query and every pipeline stage over whole small tables."""
import hashlib
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_dedup import brute_near, brute_removed
from test_llm_search import words
from tokenizers import Tokenizer

import corpus_pipeline as P
from lendlens.llm.queries import QUERIES, SQL

LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
held_out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def documents(spark, sf_small):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def labels(spark, sf_small):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}


def rows(spark, sf_small, name):
    return QUERIES[name](spark, sf_small).collect()


def benchmark_windows(spark, sf_small, width=10):
    out = {}
    for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect():
        w = words(r["text"])
        for k in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(tuple(w[k:k + width]), set()).add(r["item_id"])
    return out


def hits(text, windows):
    w, hit, items = words(text), set(), set()
    for z in {len(k) for k in windows}:
        for a in range(len(w) - z + 1):
            if tuple(w[a:a + z]) in windows:
                hit.update(range(a, a + z))
                items |= windows[tuple(w[a:a + z])]
    return len(w), len(hit), items


def test_quality_on_held_out_rows(spark, sf_small, documents, labels):
    got = {r["doc_id"]: r for r in rows(spark, sf_small, "op1_quality")}
    assert len(got) == len(documents) and all(r["held_out"] == held_out(i) for i, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    judged = [got[i]["predicted"] == y for i, y in labels.items() if held_out(i)]
    assert sum(judged) / len(judged) > 0.85


def test_languages_on_held_out_rows(spark, sf_small, documents):
    got = {r["doc_id"]: r for r in rows(spark, sf_small, "op4_language_id")}
    assert len(got) == len(documents) and all(r["held_out"] == held_out(i) for i, r in got.items())
    judged = [got[i]["lang_pred"] == lang for i, _, lang in documents if held_out(i)]
    assert sum(judged) / len(judged) > 0.95


def test_decontamination_query(spark, sf_small, documents):
    windows = benchmark_windows(spark, sf_small)
    got = {r["doc_id"]: r for r in rows(spark, sf_small, "op2_decontaminate")}
    for i, text, _ in documents:
        n, hit, items = hits(text, windows)
        want = (n, hit, len(items), sha(",".join(sorted(map(str, items)))), hit > 0)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want


def test_token_queries(spark, sf_small, documents):
    counted = {r["doc_id"]: r for r in rows(spark, sf_small, "op5_token_counts")}
    coded = {r["doc_id"]: r for r in rows(spark, sf_small, "op9_bpe_codec")}
    for i, text, _ in documents:
        ids = LIB.encode(text or "", add_special_tokens=False).ids
        a, b = counted[i], coded[i]
        assert (a["n_bytes"], a["n_tokens"], a["over_limit"]) == (len((text or "").encode()), len(ids), len(ids) > 2048)
        assert (b["n_tokens"], b["ids_sha256"], b["decoded_sha256"]) == (
            len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False)))


def test_dedup_queries(spark, sf_small, documents):
    pairs = [(i, t) for i, t, _ in documents]
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, sf_small, "op6_minhash_neardup")}
    assert near == brute_near(pairs, 3, 85)
    cut = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, sf_small, "op10_substring_dedup")]
    assert sorted(cut) == sorted((i, n, g, sha(t)) for i, n, g, t in brute_removed(pairs, 13))


def test_top_k_query_equals_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_small}/embeddings.parquet')")
    got = QUERIES["op7_exact_topk"](spark, sf_small).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["op7_exact_topk"]).fetchall())


@pytest.mark.parametrize("name, tables", [("op11_prefix_trie", ["conversations"]), ("op12_source_divergence", ["documents"])])
def test_queries_equal_sql(spark, sf_small, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    got = QUERIES[name](spark, sf_small).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))


def test_row_queries_keep_all_rows(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").count()
    assert len(rows(spark, sf_small, "op3_url_filter")) == pages
    chats = spark.read.parquet(f"{sf_small}/conversations.parquet").count()
    got = rows(spark, sf_small, "op8_quote_links")
    assert len(got) == chats and all(r["reply_to"] is None or r["reply_to"] < r["turn"] for r in got)


def test_each_stage(spark, sf_small, documents):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    odd = [(9001, None), (9002, ""), (9003, "123 !!"), (9004, documents[0][1]), (None, documents[1][1])]
    more = spark.createDataFrame([(i, t, "en", "extra", 0) for i, t in odd], docs.schema)
    docs = docs.union(more).withColumn("score", F.lit("clash"))
    stage = dict(P.STAGES)
    take = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    every = take(docs)

    kept = stage["language_id"](spark, docs, sf_small)
    assert kept.columns == docs.columns
    gone = set(every) - set(take(kept))
    assert {(9001, None), (9002, ""), (9003, "123 !!")} <= gone and len(gone) <= 3 + len(every) // 50

    named = [(i, t) for i, t in every if i is not None]
    parts = brute_near(named, 5, 80)
    one = take(stage["near_dedup"](spark, docs, sf_small))
    assert sorted(map(str, one)) == sorted(map(str, [(i, t) for i, t in named if parts[i][1] == i] + [(None, documents[1][1])]))

    cut = stage["substring_dedup"](spark, docs, sf_small)
    assert cut.columns == docs.columns
    big = 1 << 62
    want = [(i if i != big else None, t if not g else k) for (i, t), (_, _, g, k) in
            zip([(big if i is None else i, t) for i, t in every],
                brute_removed([(big if i is None else i, t) for i, t in every], P.PASSAGE_WORDS), strict=True)]
    assert sorted(map(str, take(cut))) == sorted(map(str, want))

    windows = benchmark_windows(spark, sf_small, P.ITEM_WORDS)
    clean = take(stage["decontamination"](spark, docs, sf_small))
    assert sorted(map(str, clean)) == sorted(str((i, t)) for i, t in every if not hits(t, windows)[1])

    coded = stage["bpe"](spark, docs, sf_small).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], tuple(r["ids"])) for r in coded) == sorted(
        (str(i), len(e), tuple(e)) for i, t in every for e in [LIB.encode(t or "", add_special_tokens=False).ids])


def test_language_stage_drops_unknown_scripts_and_keeps_mixtures(spark, sf_small):
    rng = random.Random(6)
    speak = lambda x, n: " ".join("".join(rng.choice(x) for _ in range(3)) for _ in range(n))
    kinds = {"aa": ["ba", "be", "do"], "bb": ["kro", "pst", "sta"], "cc": ["щу", "ме", "ли"]}
    told = [(i, speak(x, 40), lang) for i, (lang, x) in enumerate([*kinds.items()] * 60)]
    three = " ".join(speak(x, 40) for x in kinds.values())
    new = [(900, "日本語の文章", None), (901, "ελληνικά κείμενα", None), (902, three, None), (903, told[0][1] + "日本語" * 300, None)]
    docs = spark.createDataFrame(told + new, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in P.language_id(spark, docs, sf_small).collect()}
    assert kept == {i for i, _, _ in told} | {902}


def test_short_items_alone_do_not_condemn_a_document(spark, tmp_path):
    rest = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"q{i}" for i in range(12))
    items = [(1, "Paris"), (2, "paris!"), (3, long), (None, "blue whale"), (4, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"{rest} Paris {rest} paris", "to Paris", f"{rest} paris {rest} Blue Whale", f"{rest} {long}", rest, f"{rest} blue whale", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    kept = {r["doc_id"] for r in P.decontamination(spark, docs, str(tmp_path)).collect()}
    assert kept == {0, 4, 5, 6}


def test_stages_of_an_empty_table(spark, sf_small):
    none = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, sf_small).count() == 0


def test_pipeline_runs_its_stages(spark, sf_small, documents):
    got = P.run(spark, sf_small).collect()
    assert 0 < len(got) < len(documents)
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    assert len({r["doc_id"] for r in got}) == len(got) and all(re.fullmatch("[0-9a-f]{64}", r["decoded_sha256"]) for r in got)
