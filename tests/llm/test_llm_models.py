"""Language ID, the quality classifier and quotation linking."""
import random

import numpy as np
import pytest

from lendlens.llm import langid, quality, quotes
from lendlens.llm.blocks import text_bytes

SYLLABLES = {"aa": "ba be bi bo bu da de".split(), "bb": "kro kri ktu pst sta rgh".split(), "cc": "жа зо ли не".split()}


def speak(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    rows = [(i, speak(x, rng.randint(3, 60), rng), x) for i in range(120) for x in SYLLABLES]
    return langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_languages_and_spans(spark, model):
    rng = random.Random(1)
    a, b, c = (speak(x, 30, rng) for x in SYLLABLES)
    texts = {0: a, 1: b, 2: c, 3: f"{a}. {b}! {a}", 4: None, 5: "", 6: "123 -- !!", 7: "日本語", 8: a, 9: "x" * 20000, 10: c + " " + a}
    docs = spark.createDataFrame([(i, t, "zz", 1.0) for i, t in texts.items()], "doc_id bigint, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.identify(docs, model).select("row.doc_id", "lang_pred", "score", "spans").collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, 8)] == ["aa", "bb", "cc", "aa", "aa"]
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["spans"] for i in (4, 5, 6))
    assert got[7]["lang_pred"] in SYLLABLES and all(0 <= r["score"] <= 1 for r in got.values())
    mixed = [(s["lang"], texts[3][s["begin"]:s["stop"]]) for s in got[3]["spans"]]
    assert mixed == [("aa", a), ("bb", b), ("aa", a)]
    assert [s["lang"] for s in got[10]["spans"]] == ["cc", "aa"]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_letters_of_unknown_scripts_are_no_evidence(spark, model):
    rng = random.Random(8)
    a, b, c = (speak(x, 30, rng) for x in SYLLABLES)
    letters = lambda t: sum(x.isalpha() for x in t)
    alien = "日本語" * 200
    texts = {0: alien, 1: a + " " + alien, 2: f"{a} {b} {c}", 3: "ελληνικά κείμενα"}
    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    got = {r["row"]["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["score"] == got[i]["known"] == 0 and got[i]["lang_pred"] in SYLLABLES for i in (0, 3))
    assert got[1]["lang_pred"] == "aa" and got[1]["score"] == got[1]["known"] == pytest.approx(letters(a) / (letters(a) + 600))
    assert got[2]["known"] == 1 and got[2]["score"] < 0.7


def test_no_labels_no_model(spark):
    with pytest.raises(ValueError, match="no labelled texts"):
        langid.fit(spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string"))


@pytest.mark.parametrize("piece", [1, 2, 3, 128])
def test_viterbi_equals_all_paths(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = np.random.default_rng(3)
    score = rng.normal(size=(9, 3))
    first = np.array([0, 5, 5, 9, 10])
    number = rng.integers(0, 9, 10)
    label = langid.best_labels(score, number, first, 0.7)
    from itertools import product
    for d in range(4):
        own = number[first[d]:first[d + 1]]
        value = lambda p, own=own: sum(score[w, s] for w, s in zip(own, p, strict=True)) - 0.7 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max((value(p) for p in product(range(3), repeat=len(own))), default=0)
        assert value(label[first[d]:first[d + 1]]) == pytest.approx(best)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.grow(x[:2000], y[:2000], trees=30, depth=3)
    assert ((forest.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    walk = []
    for row in x[:50]:
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if row[f[k]] > t[k] else 1)
            total += leaf[k - len(f)]
        walk.append(1 / (1 + np.exp(-total)))
    assert np.allclose(walk, forest.scores(x[:50]))


def test_quality_of_texts(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["plain", "words", "go", "on", "here"]) for _ in range(40)) + "."
    bad = lambda: "".join(rng.choice("#$%&*!!\n ") for _ in range(150))
    rows = [(i, good() if i % 2 else bad(), i) for i in range(400)] + [(900, None, 0), (901, "", 0), (902, "x" * 50000, 0), (902, "x" * 50000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(300)] + [(5000, 1, 1), (None, 1, 1), (3, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    forest = quality.fit(docs, labels, "quality")
    got = quality.score(docs, forest).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    said = {r["doc_id"]: r["score"] for r in got}
    assert all((said[i] >= 0.7) == bool(i % 2) for i in range(300, 400))
    assert said[900] == said[901]
    with pytest.raises(ValueError, match="no labelled rows"):
        quality.fit(docs, labels.limit(0), "quality")
    assert quality.score(docs.limit(0), forest).count() == 0


def test_repeated_labels_do_not_swell_the_sample(spark, monkeypatch):
    grown = []
    monkeypatch.setattr(quality, "grow", lambda x, y: grown.append(sorted(y)))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(7, 1)] * 900 + [(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    quality.fit(docs, labels, "quality")
    assert grown[-1] == [0.0] * 20 + [1.0] * 20
    quality.fit(docs, labels, "quality", sample=1)
    assert set(grown[-1]) == {0.0, 1.0} and len(grown[-1]) <= 20


def test_statistics_do_not_mix_texts():
    import pyarrow as pa
    texts = ["One two.\nThree two two", "", "AB!!", None, "a" * 300, "One two.\nThree two two"]
    together = quality.statistics(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(*text_bytes(pa.array([t], pa.string())))[0], together[i]), t


CHAT = [(1, 0, "Hello there\nHow are you?"), (1, 1, "> How are you?\nFine"), (1, 2, "unrelated"),
        (1, 3, ">> How are you?\n> fine\nGood to hear"), (1, 4, "next"), (1, 5, "> hello   THERE\n> how are you?\nlate reply"),
        (2, 0, None), (2, 7, "> nothing known"), (None, 1, "x"), (3, 0, ""), (3, 1, "> \n>\n"), (2, 8, "> Good to hear")]


def brute_path(replies, conv, turn):
    up = replies[conv, turn]
    if up is not None and up == turn - 1:
        return brute_path(replies, conv, up)
    above = brute_path(replies, conv, up) if up is not None else []
    return [*above, (-up if up is not None else 1, turn)]


def test_replies_follow_quotes(spark):
    df = spark.createDataFrame([(c, t, "user", x, 5) for c, t, x in CHAT], "conv_id bigint, turn bigint, role string, text string, path int")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.format_conversations(df).collect()}
    assert len(got) == len(CHAT)
    replies = {k: r["reply_to"] for k, r in got.items()}
    assert replies == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 3, (1, 5): 0, (2, 0): None, (2, 7): None,
                       (None, 1): None, (3, 0): None, (3, 1): 0, (2, 8): 7}
    assert got[1, 3]["text"] == "Good to hear" and got[1, 3]["quotes"] == got[1, 3]["linked"] == 2
    assert got[2, 7]["text"] == "" and (got[2, 7]["quotes"], got[2, 7]["linked"]) == (1, 0)
    for (c, t), r in got.items():
        if c is not None:
            assert [tuple(s) for s in r["path"]] == brute_path(replies, c, t)
    order = sorted((t for c, t in got if c == 1), key=lambda t: ([tuple(s) for s in got[1, t]["path"]], t))
    assert order == [0, 1, 2, 3, 4, 5]
    assert quotes.format_conversations(df.limit(0)).count() == 0


def test_no_line_is_lost(spark):
    code = "def f():\n    return 1\n\n\t- a:  b "
    rows = [(1, 0, code), (1, 1, f" \n{code}\n\n> def f():\n>   RETURN 1\n>>> print(2)\n>\nas said"),
            (1, 2, ">>> x = 1\n> def f():\n> not known\nso"), (1, 2, "> other row"), (None, 3, "> a\n  b"), (1, 4, "  \n\t"), (1, 5, None)]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    got = sorted((r["turn"], r["text"], [tuple(u) for u in r["unlinked"]]) for r in quotes.format_conversations(df).collect())
    assert got == sorted([
        (0, code, []), (1, code + "\n\nas said", [(8, ">>> print(2)")]),
        (2, "so", [(0, ">>> x = 1"), (2, "> not known")]), (2, "", [(0, "> other row")]),
        (3, "  b", [(0, "> a")]), (4, "", []), (5, "", [])])


def test_last_before_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(quotes, "TURNS", 3)
    rng = random.Random(4)
    rows = [(c, t, rng.choice([None, None, t * 10])) for c in (1, 2) for t in range(20)]
    df = spark.createDataFrame(rows, "k bigint, turn bigint, value bigint")
    got = {(r["k"], r["turn"]): r["out"] for r in quotes.last_before(df, ["k"], "turn", "value", "out").collect()}
    for c, t, _ in rows:
        assert got[c, t] == max((v for k, u, v in rows if k == c and u < t and v is not None), default=None)
