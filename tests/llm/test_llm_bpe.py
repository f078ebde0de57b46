"""Encoder, decoder and prefix counts against the tokenizers library."""
import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lendlens.llm import bpe_codec, token_counts
from lendlens.llm.blocks import text_bytes
from lendlens.llm.bpe import WordBpe, units

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n\n", "<|endoftext|>", "a<|startoftext|>B", "<|ENDOFTEXT|>", "it's I'LL ''s", "</w>", "É é́ ΑΣ", "１２ 12",
       "中文 и кириллица", "tab\tnew\u00a0\u0085x", "\x00\x1c", "🙂🙂!!", "x" * 3000, "ab " * 2000, "ß×÷ÿÞ"]


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as f:
        return WordBpe(f.read())


def ids_of(bpe, texts):
    w = units(*text_bytes(pa.array(texts, pa.string())))
    flat = [bpe_codec.unit_ids(bpe, u) for u in w.dictionary.to_pylist()]
    import numpy as np
    return [[int(i) for c in w.codes[w.first[d]:w.first[d + 1]] for i in np.frombuffer(flat[c], np.int32)] for d in range(len(texts))]


def test_ids_equal_the_library(bpe):
    rng = random.Random(5)
    signs = list("abcdefghijklmnopqrstuvwxyzABC'.,!<|>/ \n\t019éñüßÉÞ×÷ÿΣςİ中🙂́\u0085 \x1c%$#&*-_")
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = ids_of(bpe, texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids == LIB.encode(text, add_special_tokens=False).ids, text


def test_prefix_tables_count_as_the_encoder_does(bpe):
    for word in ["thereupon", "internationalization", "aaaaaaaaaaaaa", "xqzjk"]:
        s = bpe.symbols(word)
        for j in range(1, len(s) + 1):
            cut = word[:j]
            assert bpe.cut_count(s, j) == len(LIB.encode(cut, add_special_tokens=False).ids), cut


def frame(spark, texts, extra=True):
    rows = [(i, t, f"x{i}", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens double")


def test_operators_on_odd_rows(spark):
    texts = [None, *ODD, ODD[4], ODD[4]]  # repeated texts; columns named like the results
    docs = frame(spark, texts)
    want = [LIB.encode(t or "", add_special_tokens=False).ids for t in texts]
    coded = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH).select("row.doc_id", "ids", "decoded").collect()
    for r in coded:
        assert r["ids"] == want[r["doc_id"]]
        assert r["decoded"] == LIB.decode(want[r["doc_id"]], skip_special_tokens=False)
    counted = {r["doc_id"]: r for r in token_counts.token_prefixes(docs, PATH).collect()}
    assert len(counted) == len(texts)
    for i, t in enumerate(texts):
        assert counted[i]["n_tokens"] == len(want[i]) and counted[i]["n_bytes"] == len((t or "").encode())
        assert (counted[i]["counts"] or [0])[-1] == len(want[i])


def test_any_prefix_and_budget(spark):
    text = "The theoretical counterpoint, internationally 12,5% overrun."
    docs = spark.createDataFrame([(i, text, i) for i in range(len(text) + 1)], "doc_id bigint, text string, at bigint")
    table = token_counts.token_prefixes(docs, PATH)
    got = {r["at"]: r["n_tokens"] for r in token_counts.count_at(table, docs, "at", PATH).collect()}
    assert got == {i: len(LIB.encode(text[:i], add_special_tokens=False).ids) for i in got}
    cut = token_counts.fit_budget(table.where("doc_id = 0"), 4).first()
    assert cut["keep_tokens"] <= 4
    assert cut["keep_tokens"] == len(LIB.encode(text[:cut["keep_bytes"]], add_special_tokens=False).ids)


def counts_of(text):
    return [len(LIB.encode(text[:j], add_special_tokens=False).ids) for j in range(len(text) + 1)]


def test_counts_of_all_prefixes(bpe):
    rng = random.Random(9)
    signs = list("abcdeABC'.,!<|>019éñüßÉςΣİ中日本ですがタイ") + ["\u0301", "\u3099", "\u1112", "\u1161", "\u11ab", "\u00a0", "🙂", "e\u0301",
                                                                 "<|endoftext|>", "'ll", "'re", "ที่"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    for text in [*texts, "it's'", "a<|startoftext|>B", "中文" * 40]:
        assert bpe.text_counts(text) == counts_of(text), text


def test_longest_prefix_inside_long_units(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("天地玄黄宇宙洪荒日月") for _ in range(120)), "ภาษาไทยไม่มีช่องว่าง" * 5, "  日本語テキスト \n\n ab internationally  ",
             "x" * 200, "", None, "   ", "thereupon" * 9, "caf\u00e9s don't<|endoftext|>go"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    table = token_counts.token_prefixes(docs, PATH).cache()
    for budget in (0, 1, 3, 10, 57, 10000):
        got = {r["doc_id"]: (r["keep_bytes"], r["keep_tokens"]) for r in token_counts.fit_budget(table, budget).collect()}
        for i, text in enumerate(t or "" for t in texts):
            n = counts_of(text)
            j = max(j for j in range(len(n)) if n[j] <= budget)
            assert got[i] == (len(text[:j].encode()), n[j]), (text, budget)
    places = [(i, t, at) for i, t in enumerate(texts) for at in range(0, len((t or "").encode()) + 2, 3)]
    cuts = spark.createDataFrame(places, "doc_id bigint, text string, at bigint")
    got = token_counts.count_at(table, cuts, "at", PATH).collect()
    assert len(got) == len(places)
    for r in got:
        cut = (texts[r["doc_id"]] or "").encode()[:r["at"]].decode(errors="ignore")
        assert r["n_tokens"] == len(LIB.encode(cut, add_special_tokens=False).ids)


def test_counts_of_rows_that_share_an_id(spark):
    rows = [(None, "one two", 3), (None, "日本語", 6), (7, "a b c", 5), (7, "thereupon", 9), (8, "no place", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, at bigint")
    got = token_counts.count_at(token_counts.token_prefixes(docs, PATH), docs, "at", PATH).collect()
    want = [(i, at, None if at is None else len(LIB.encode(t.encode()[:at].decode(), add_special_tokens=False).ids)) for i, t, at in rows]
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))


def test_empty_table(spark):
    none = frame(spark, ["x"]).limit(0)
    assert bpe_codec.encode(none, PATH).count() == 0
    assert token_counts.token_prefixes(none, PATH).count() == 0
