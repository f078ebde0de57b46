"""Near-duplicates, substring dedup and components against brute force."""
import random
import re

import numpy as np
import pytest

from lendlens.llm import graph, neardup, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, n bigint, id string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(n)]


def copies(seed=3, groups=6, size=14):
    """Texts in groups of edited copies, drifting away from each other."""
    rng, words, out = random.Random(seed), vocabulary(), []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([40, 90, 150]))]
        for _ in range(size):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                base[rng.randrange(len(base))] = rng.choice(words)
    rng.shuffle(out)
    return out


def odd_texts():
    return [None, "", "  \n", "one", "ONE", "one two", "a b c", "A  B\tC", "a b c a b c a b c", "x " * 5000, "x " * 5001]


def brute_near(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    part = {i: i for i, _ in rows}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(rows[a][0]), root(rows[b][0])
                part[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize("group", [512, 6])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(neardup, "GROUP", group)  # 6: components are dealt in blocks
    rows = list(enumerate(odd_texts() + copies()))
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_near(rows, 3, 85)


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, 0, ""), (None, "a b c d", 0, ""), (2, "a b c d", 0, "")], SCHEMA)
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(1, 1), (None, 2), (2, 2)}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_tensored_keys_meet_for_like_sets():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.choice(1 << 40, 200, replace=False).astype(np.uint64)
        other = base.copy()
        other[:8] = rng.choice(1 << 41, 8).astype(np.uint64) + np.uint64(1 << 41)
        x = np.concatenate([base, other])
        a, b = neardup.band_keys(x, np.array([0, 200, 400]), 3, 16)
        assert (a[0] == a[1]).any() and (b[0] == b[1]).any()


def brute_removed(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a:a + window])] < i:
                gone[a:a + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("window", [2, 5, 13])
def test_removed_words_equal_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 1500)  # many blocks
    monkeypatch.setattr(substrings, "RANGE_BYTES", 4000)  # many ranges
    rng, words = random.Random(9), vocabulary(60)
    passage = " ".join(rng.choice(words) for _ in range(20))
    texts = odd_texts() + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice(["", " " + passage + "\n"])
                           for _ in range(60)] + [passage] * 3
    rows = [(rng.randrange(10_000), t) for t in texts] + [(5, passage), (5, passage)]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], SCHEMA).repartition(4)
    found = substrings.remove_repeats(docs, window, keep=docs.columns).select("row.*", "n_words", "n_removed", "kept_text", "spans")
    got = found.collect()
    assert all(r["id"] == "z" for r in got)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted(brute_removed(rows, window))
    assert all(sum(s["stop"] - s["begin"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_removal_without_ids_and_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text, 0, "a"), (3, text, 0, "b"), (None, text, 0, "c")], SCHEMA)
    got = {r["id"]: r["n_removed"] for r in substrings.remove_repeats(docs, keep=["id"]).select("row.id", "n_removed").collect()}
    assert got == {"a": 20, "b": 0, "c": 20}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_doubling_goes_on_until_nothing_survives(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, shared + " x", 0, ""), (2, "y " + shared, 0, ""), (3, " ".join(f"v{i}" for i in range(40)), 0, ""),
                                  (4, " ".join(f"w{i}" for i in range(15)), 0, "")], SCHEMA)
    got = {r["doc_id"]: r["longest"] for r in substrings.longest_repeats(docs, 13).collect()}
    assert got == {1: 52, 2: 52, 3: 0, 4: 13}


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (139, 100), (200, 150)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 150, 150: 150}
    assert got == want
    assert graph.components(df.limit(0)).count() == 0
