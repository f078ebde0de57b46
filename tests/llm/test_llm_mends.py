"""Empty tables, repeated ids, gaps in turns, all code points, exchange size;
brute-force twins of the quality forest and the quotation links."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from lendlens.llm import langid, neardup, quality, queries, quotes, substrings, token_counts, urlfilter
from lendlens.llm.bpe import WordBpe, other_versions
from lendlens.llm.queries import QUERIES

VOCAB = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def nothing(spark, sf_small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{sf_small}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_of_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def test_queries_without_labels(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_small}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert {(r["score"], r["predicted"]) for r in QUERIES["op1_quality"](spark, str(tmp_path)).collect()} == {(0.5, 0)}
    assert {(r["score"], r["lang_pred"]) for r in QUERIES["op4_language_id"](spark, str(tmp_path)).collect()} == {(0.0, "und")}


def test_a_language_under_one_id_is_learned(spark):
    rng = random.Random(4)
    speak = lambda x: " ".join("".join(rng.choice(x) for _ in range(3)) for _ in range(20))
    for one in (1, 5, 77):
        rows = [(one, speak(["ba", "be", "do"]), "aa") for _ in range(400)] + [(i, speak(["kro", "pst"]), "bb") for i in range(300)]
        rows += [(9, "same text", "cc")] * 300 + [(None, "щуме", "dd")] * 3
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        model = langid.fit(docs, per_lang=50)
        assert model.langs == ["aa", "bb", "cc", "dd"]
        got = {(r["row"]["doc_id"], r["lang_pred"]) for r in langid.identify(docs, model).collect()}
        assert (one, "aa") in got and (9, "cc") in got and (None, "dd") in got


def test_quality_learns_one_row_of_each_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i} of many.") for i in range(3000)] + [(i, "AAA 11 ##" if i % 2 else "calm words, here.") for i in range(2, 200)],
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)] * 2, "doc_id bigint, quality int")
    seen = []
    grow = quality.grow
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.append(x.shape) or grow(x, y))
    forest = quality.fit(docs, labels, "quality")
    assert seen[0][0] == 199
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, forest).where("doc_id > 1").collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in got)


def test_forest_equals_a_plain_tree_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    forest = quality.grow(x, y, trees=40, depth=3)
    for row, score in zip(x, forest.scores(x), strict=True):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            k = 0
            while k < len(feature):
                k = 2 * k + 1 + int(row[feature[k]] > threshold[k])
            total += leaf[k - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((forest.scores(x) > 0.5) == (y == 1)).mean() > 0.9
    # the first split of the first tree is the best of all by an exhaustive search
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    best = max((gain(x[:, f] <= t) + gain(x[:, f] > t), -f, -t) for f in range(5) for t in np.unique(np.quantile(
        x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) if min((x[:, f] <= t).sum(), (x[:, f] > t).sum()) >= quality.LEAST)
    first = forest.feature[0][0], forest.threshold[0][0]
    assert gain(x[:, first[0]] <= first[1]) + gain(x[:, first[0]] > first[1]) == pytest.approx(best[0])


MARKS = re.compile(r"^(?:[ \t]*>)+")
normal = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")


def brute_links(rows):
    """Reply of every message, by comparing all quoted units with all earlier ones."""
    chats, replies = defaultdict(dict), {}
    for c, t, text in rows:
        chats[c][t] = text or ""
    for c, turns in chats.items():
        owns = {}
        for at in sorted(turns):
            lines = [(len(MARKS.match(s)[0].replace(" ", "").replace("\t", "")) if MARKS.match(s) else 0, s) for s in turns[at].split("\n")]
            plain = [s for level, s in lines if level == 0]
            while plain and not plain[0].strip():
                plain.pop(0)
            while plain and not plain[-1].strip():
                plain.pop()
            parts = re.split(r"\n\s*\n", "\n".join(plain))
            passages, last = [], None
            for level, s in lines:
                if level and level == last:
                    passages[-1][1].append(normal(MARKS.sub("", s)))
                elif level:
                    passages.append((level, [normal(MARKS.sub("", s))]))
                last = level
            score = Counter()
            for level, body in passages:
                for unit in {normal(" ".join(body)), *body} - {""}:
                    earlier = [t for t in owns if t < at and unit in owns[t]]
                    if earlier:
                        score[level, max(earlier)] += len(unit)
            before = [t for t in turns if t < at]
            replies[c, at] = max((-level, n, t) for (level, t), n in score.items())[2] if score else max(before, default=None)
            owns[at] = {normal(" ".join(plain)), *map(normal, plain), *map(normal, parts)} - {""}
    return replies


def test_reply_links_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in range(40):
        said, at = [], 0
        for _ in range(rng.randrange(1, 14)):
            at += rng.choice([1, 1, 2, 7])
            own = [" ".join(rng.choices(["aye", "bee", "Sea", "dee"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))]
            quoted = []
            for line in rng.sample(said, min(len(said), rng.randrange(3))) if said else []:
                quoted.append("> " * rng.choice([1, 1, 2]) + rng.choice([line, line.upper(), "new words"]))
            rows.append((c, at, "\n".join(quoted + own)))
            said += own
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id int, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in quotes.format_conversations(df, across_gaps=True).collect()}
    assert got == brute_links(rows)


def test_gaps_in_turns_and_text_ids(spark):
    rows = [("c-1", 0, "u", "hello"), ("c-1", 2, "v", "hi"), ("c-1", 4, "u", "> hello\nback"), ("c-1", 9, "v", "end"), ("c-2", 5, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.format_conversations(df, across_gaps=True).collect()}
    assert {k: r["reply_to"] for k, r in got.items()} == {
        ("c-1", 0): None, ("c-1", 2): 0, ("c-1", 4): 0, ("c-1", 9): 4, ("c-2", 5): None}
    # 2 follows 0 in its run, 4 branches off 0, 9 follows 4
    assert len(got["c-1", 2]["path"]) == 1 and got["c-1", 4]["path"] == got["c-1", 9]["path"] and len(got["c-1", 9]["path"]) == 2
    odd = df.withColumn("turn", F.when(F.col("turn") == 9, "last").otherwise(F.col("turn").cast("string")))
    assert quotes.format_conversations(odd, across_gaps=True).where("reply_to is not null").count() == 2


def test_a_very_long_message_is_parsed_whole(spark):
    text = "\n".join(f"> line {i}" for i in range(1500)) + "\nmine"
    df = spark.createDataFrame([(1, 0, "u", "\n".join(f"line {i}" for i in range(1500))), (1, 1, "v", "no"), (1, 2, "u", text)],
                               "conv_id int, turn int, role string, text string")
    r = quotes.format_conversations(df, across_gaps=True).where("turn = 2").first()
    assert (r["reply_to"], r["text"], r["quotes"], r["linked"], r["unlinked"]) == (0, "mine", 1, 1, [])


def test_every_code_point_is_cut_as_the_library_cuts_it():
    lib = Tokenizer.from_file(VOCAB)
    with open(VOCAB, encoding="utf-8") as f:
        bpe = WordBpe(f.read(), other_versions(VOCAB))
    # all planes with characters; of the large uniform blocks the ends
    uniform = [(0x4E10, 0x9FF0), (0xAC10, 0xD790), (0x17010, 0x187F0), (0x20010, 0x2A6D0), (0x2A710, 0x33470), (0x33480, 0x3FFF0), (0xE1000, 0x10FFF0)]
    for shape in ("ab%scd", "1%s%s"):
        points = [c for c in [*range(0x40000), *range(0xE0000, 0xE1000)] if not 0xD800 <= c < 0xF8F0
                  and not any(a <= c < b for a, b in uniform) and chr(c) not in "\x00"]
        texts = [shape.replace("%s", chr(c)) for c in points]
        bad = []
        for c, text, e in zip(points, texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            own = [i for unit in re.split("[ \t-\r]+", text) for p in bpe.pieces(unit) for i in ([p] if isinstance(p, int) else bpe.encode_piece(p))]
            if own != e.ids:
                bad.append(hex(c))
        assert not bad, (shape, len(bad), bad[:20])


def test_a_block_sends_no_more_rows_than_hashes(spark):
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 300)).astype(np.uint64) << np.uint64(2)
    for ranges in (1, 7, 1000, 1 << 31):
        some, cut = substrings._cuts(h, ranges, 64)
        assert len(some) == len(cut) - 1 <= min(len(h), ranges) and cut[0] == 0 and cut[-1] == len(h)
        assert (np.diff(some) > 0).all() and (some < ranges).all()
    assert [len(x) for x in substrings._cuts(h[:0], 5, 64)] == [0, 1]
    # rows of one exchange, for a corpus and for twice the corpus over the same number of ranges
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    docs = [(i, words(400)) for i in range(200)]
    made = []
    for part in (docs[:100], docs):
        blocks = substrings.make_blocks(spark.createDataFrame(part, "doc_id bigint, text string").repartition(len(part) // 20),
                                        "doc_id", "text", ["doc_id"])
        made.append(substrings._ask(blocks, [7], 50, False).count())
    assert 1.8 < made[1] / made[0] < 2.2


def test_no_near_duplicate_is_lost(spark, sf_small):
    """Recall of the links against an inverted index over true word sets."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    for width, percent in ((3, 85), (5, 80)):
        sets, posting, links = {}, defaultdict(list), []
        for i, text in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
            sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
            both = Counter(j for s in sets[i] for j in posting[s])
            links += [(i, j) for j, n in both.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
            for s in sets[i]:
                posting[s].append(i)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(
            spark.createDataFrame(rows, "doc_id bigint, text string"), width=width, percent=percent).collect()}
        assert links and all(got[i] == got[j] for i, j in links)


def test_near_stage_keeps_the_smallest_text_of_an_id(spark, sf_small):
    rows = [(1, "b b b", 1), (1, "a a a", 2), (1, "a a a", 2), (2, "c c c", 3), (3, "c c c", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    for n in (1, 5):
        got = sorted(map(tuple, P.near_dedup(spark, docs.repartition(n), sf_small).collect()))
        assert got == [(1, "a a a", 2), (2, "c c c", 3)]


def test_verdicts_equal_plain_logistic_scoring(spark, sf_small, monkeypatch):
    models, real = [], urlfilter.fit
    monkeypatch.setattr(urlfilter, "fit", lambda *a: models.append(real(*a)) or models[-1])
    got = QUERIES["op3_url_filter"](spark, sf_small).collect()
    weights, base = models[0].coefficients.toArray(), models[0].intercept
    tf, slot = HashingTF(numFeatures=urlfilter.BINS), {}
    modelled = 0
    for r in got:
        grams = [mark + t[i:i + n] for mark, part in (("h", r["host"]), ("p", r["path"])) for t in [f"^{part}$"]
                 for n in urlfilter.GRAMS for i in range(len(t) - n + 1)]
        z = base + sum(weights[slot[g] if g in slot else slot.setdefault(g, tf.indexOf(g))] for g in grams)
        p = 1 / (1 + math.exp(-z))
        assert r["score"] == pytest.approx(p, abs=1e-9)
        if r["rule"] is None:
            modelled += 1
            assert r["verdict"] == ("block" if p > 0.5 else "allow")
    assert modelled and len(got) == spark.read.parquet(f"{sf_small}/pages.parquet").count()


def test_the_cut_at_the_limit_is_the_longest_prefix(spark, tmp_path, monkeypatch):
    texts = [None, "", " \n ", "Plain words, then more of them; and 12345 digits!", "été à la façade où naïve çédille über straße",
             "they're we'll 'tis ''s'", "日本語の長い文には空白がありません", "x" * 90, "  led  by   spaces  " * 4, "<|endoftext|> a <|startoftext|> b c d e f",
             "é́ ö комбинация ՘՘", "unbelievablyinternationalisation " * 3, "ok"]
    rows = [(i, t, i) for i, t in enumerate(texts + texts[3:5])]
    spark.createDataFrame(rows, "doc_id bigint, text string, counts int").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "TOKEN_LIMIT", 6)
    got = {r["doc_id"]: r for r in QUERIES["op5_token_counts"](spark, str(tmp_path)).collect()}
    lib = Tokenizer.from_file(VOCAB)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        t, r = t or "", got[i]
        keep = max(j for j in range(len(t) + 1) if n(t[:j]) <= 6)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n(t), n(t) > 6), t
        assert (r["keep_bytes"], r["keep_tokens"]) == (len(t[:keep].encode()), n(t[:keep])), t


def test_a_memo_of_two_generations_keeps_what_is_met_again():
    asked = []
    memo = token_counts.Generations(lambda k: asked.append(k) or k * 2, limit=2)
    for k in [1, 2, 1, 3, 1, 4, 5, 1, 6, 1]:
        assert memo(k) == 2 * k
    assert asked.count(1) == 1 and len(memo.known) <= 2 and len(memo.older) <= 2
