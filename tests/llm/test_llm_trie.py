"""Prefix trie, source divergence and license scan against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.llm import divergence, licenses, prefix_trie, queries
from lendlens.llm.slots import Slots

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
CHATS = "conv_id bigint, turn bigint, role string, text string, score string"


def brute_trie(rows):
    """Contract rows by walking every rebuilt conversation."""
    chats = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            chats[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in chats.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * n + sum(saved[k] for k in kids[p])
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else -1, len(members[p]), len(kids[p]), leaves[p], saved[p],
                   sha(",".join(map(str, ends[p])))) for p in members)


def got_trie(spark, tmp_path, rows, schema=CHATS, add=lambda df: df):
    add(spark.createDataFrame([(*r, "x") for r in rows], schema)).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op11_prefix_trie(spark, str(tmp_path)).collect()
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in out)


def test_trie_query_equals_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = queries.op11_prefix_trie(spark, sf_small).collect()
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in out) == brute_trie(rows)


@pytest.mark.parametrize("members", [1, 3, 1000])
def test_trie_of_shared_openings(spark, tmp_path, monkeypatch, members):
    rng = random.Random(members)
    monkeypatch.setattr(prefix_trie, "trie", lambda *a, f=prefix_trie.trie: f(*a, members=members))
    rows = []
    for c in range(300):
        for t in range(rng.choice([0, 1, 2, 5, 9])):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a b", "a  b c", "", None]) if t < 6 else f"own {c} {t}"))
    rows += [(400, t, "user", f"long {t}") for t in range(700)]  # one long chain with branches
    rows += [(400 + k, t, "user", f"long {t}") for k in range(1, 20) for t in range(0, 30 * k, 1)]
    rows += [(None, 1, "user", "x"), (7, None, "user", "first"), (7, None, "user", "first"), (41, 0, "user", "alone")]
    rows = [r for r in rows if r[0] not in (40, 60)]  # conversations whose base is absent
    assert got_trie(spark, tmp_path, rows) == brute_trie(rows)


def test_trie_of_nothing_and_of_texts_as_ids(spark, tmp_path):
    assert got_trie(spark, tmp_path, []) == []
    turns = spark.createDataFrame([("c-1", 1, "u", "a"), ("c-1", 2, "u", "b"), ("c-2", 1, "u", "a")], "conv_id string, turn int, role string, text string")
    ordered = prefix_trie.ordered_turns(turns)
    got = {(r["conv"], r["depth"]): (r["parent_conv"], r["n_convs"], r["n_leaves"], r["ends_sha256"]) for r in
           prefix_trie.trie(ordered, ordered.select("conv").distinct()).collect()}
    assert got == {("c-1", 0): (None, 2, 1, sha("")), ("c-1", 1): ("c-1", 2, 1, sha("c-2")), ("c-1", 2): ("c-1", 1, 1, sha("c-1"))}


def test_a_hot_node_and_a_long_conversation_are_spread(spark):
    """A third of the rows in one conversation, one opening for all others."""
    turns = spark.range(6000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"),
        F.when(F.col("id") < 2000, F.col("id").cast("string")).otherwise("0").alias("text"))
    ordered = prefix_trie.ordered_turns(turns)
    got = prefix_trie.trie(ordered, ordered.select("conv").distinct()).orderBy("depth").collect()
    assert len(got) == 2001 and got[1]["n_convs"] == 4001 and got[0]["n_leaves"] == 1
    assert got[1]["ends_sha256"] == sha(",".join(map(str, range(2000, 6000))))
    assert got[-1]["depth"] == 2000 and got[-1]["ends_sha256"] == sha("0")


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-1 << 62, 1 << 62, 5000), rng.integers(0, 3, 5000)
    names = Slots(a, b)
    assert sorted(names.find(a, b)) == list(range(5000))
    assert (names.find(a, b + 7) == -1).all() and len(Slots(a[:0], b[:0]).find(a[:5], b[:5])) == 5
    with pytest.raises(ValueError):
        Slots(np.array([1, 1]), np.array([2, 2]))


def brute_audit(rows, least=30, top=50):
    per, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        per[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in per}:
        kept = {t for t, n in df[lang].items() if n >= least}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (g, s), c in per.items() if g == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c):
            below = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c.get(t, 0) + 5) // below for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in groups.items()}
        for s, c in groups.items():
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s],
                     "term": [(p[s][t] - q[t], t) for t in kept if c.get(t, 0) and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def audited(df, **more):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, **more).collect())


def test_audit_query_equals_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text", "lang", "source").collect()]
    out = queries.op12_source_divergence(spark, sf_small).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in out) == brute_audit(rows)


@pytest.mark.parametrize("tile", [2, 256])
def test_audit_of_odd_documents(spark, tile):
    rng = random.Random(5)
    words = ["Ärger", "the", "THE", "x1y", "é", "Zß", "a_b", "lang" * 9, "10", "日本", "q"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(9))), rng.choice(["en", None, "", "de"]), rng.choice(["s1", "s2", "s3", "s4", None])) for _ in range(200)]
    rows += [(None, "fr", "only"), (None, "fr", "other"), ("123 !!", "xx", None)] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, n int")
    assert audited(df, least_docs=4, top=3, tile=tile, terms_at_once=3) == brute_audit(rows, 4, 3)
    small = divergence.term_counts(df, flush=7, piece=5).select("lang", "source", "term", "n", "docs").collect()
    assert sorted(small) == sorted(divergence.term_counts(df).select("lang", "source", "term", "n", "docs").collect())
    assert audited(df.limit(0)) == []


def brute_scan(text):
    low = licenses.words_of(text or "")
    at = [(i, label) for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
          for i in range(len(low)) if low[i:i + len(phrase.split())] == phrase.split()]
    places = sorted(i for i, _ in at)
    return len(low), len(at), places[0] if at else None, places[-1] if at else None, ",".join(sorted({x for _, x in at}))


def pattern(template):
    """The same template as a regular expression over words joined by blanks."""
    def one(regions):
        out = ""
        for r in regions:
            if isinstance(r, str):
                out += f" {re.escape(r)}"
            elif r[0] == "may":
                out += f"(?:{one(r[1])})?"
            elif r[0] == "any":
                out += f"(?: [^ ]+){{{r[1]},{r[2]}}}"
            else:
                out += "(?:" + "|".join("".join(f" {re.escape(w)}" for w in ws) for ws in r[1]) + ")"
        return out
    return re.compile(one(licenses.parse(template)) + "(?= |$)")


def test_scan_query_equals_brute_force(spark, sf_small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    regex = {label: pattern(t) for label, t in licenses.TEMPLATES.items()}
    got = queries.op13_license_scan(spark, sf_small).collect()
    assert len(got) == len(texts) and any(r["labels"] != r["base_labels"] for r in got)
    for r in got:
        want = brute_scan(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want
        line = "".join(f" {w}" for w in licenses.words_of(texts[r["doc_id"]] or ""))
        mine = {x for x in r["labels"].split(",") if x} - {x for x in want[4].split(",") if x}
        assert mine == {label for label, x in regex.items() if x.search(line)}
        assert (r["score"] == 1) == bool(mine) and (r["score"] >= 0.5 or not want[1]) and 0 <= r["score"] <= 1


def test_templates_accept_what_their_markup_allows(spark):
    odd = {"t": "Alpha [beta [gamma]] {1-2} {x|y z} omega", "u": "go [on] [on] now"}
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "x", "y", "z", "omega", "go", "on", "now", "foo"]
    texts = ["", None, "Alpha BETA q x omega", "alpha q w y z omega", "alpha q w e y z omega", "go on on now", "go on on on now", "alpha",
             "alpha beta gamma 1 x omega " * 3] + [" ".join(rng.choices(vocabulary, k=40)) for _ in range(150)]
    texts += [" ".join(["alpha foo x omega"] * 30_000)]  # longer than a slice
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, score string")
    got = {r["row"]["doc_id"]: r for r in licenses.scan(df, odd, {}).collect()}
    regex = {label: pattern(t) for label, t in odd.items()}
    for i, t in enumerate(texts):
        line = "".join(f" {w}" for w in licenses.words_of(t or ""))
        assert got[i]["labels"] == sorted(x for x, p in regex.items() if p.search(line)), t
    assert [s["stop"] - s["begin"] for s in got[8]["spans"]] == [6, 6, 6] and len(got[len(texts) - 1]["spans"]) == 30_000
    assert licenses.scan(df.limit(0), odd).count() == 0
    for bad in ("{0-3} word", "[may]", "a ] b", "[ a"):
        with pytest.raises(ValueError):
            licenses.Automaton.of({"bad": bad})
