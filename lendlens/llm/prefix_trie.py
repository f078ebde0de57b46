"""Conversation prefix trie (operator 11).

A node is a distinct sequence of first turns.  The digest of a prefix is the
128-bit sum of one hash per (depth, turn), so it comes from running sums over
range partitions however long a conversation is.  Rows with one digest are
counted by a grouped job, which also verifies that they agree in depth, last
turn and parent digest: by induction on the depth, equal digests then are
equal prefixes (turns being equal if 128 bits of their SHA-256 are).

A node is owned by its smallest conversation, so a conversation owns one
downward *chain* of nodes, which hangs on a node of a smaller conversation.
Sums over subtrees are sums over the tree of chains, taken in shards:

* a node with more than ``members`` members is *heavy*; ``members`` grows with
  the rows, so there are at most ``HEAVY`` heavy nodes whatever the data;
* below the heavy nodes, the chains under one topmost light node (at most
  ``members`` of them) lie in one shard.  A shard gives each chain a slot by a
  minimal perfect hash (:mod:`.slots`), scatters the chains' own sums into
  flat arrays and adds them up through the array of parent slots, deepest
  chains first;
* the heavy nodes are one more such table, fed with the sums of the chains
  that hang on them;
* a light node's sum is a running sum along its chain, from its end.

No group is larger than these bounds: a turn that a third of all conversations
begin with is a heavy node (one row after the grouped count), and a
conversation that holds a third of all rows is one chain.  One node's ends are
hashed in order, as SHA-256 requires, by one task that holds one chunk of
``CHUNK`` ids at a time.

Nulls: a null role or text is empty, a null turn comes first; rows without a
conversation belong to none and give nothing.  Turns with one number are taken
in the order of their digests, repeated rows each count as turns.  An empty
table has no node, not even a root.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.blocks import lean
from lendlens.llm.slots import Slots
from lendlens.operators.running import running_sums
from lendlens.sources.tables import materialize

HEAVY = 50_000  # most heavy nodes
MEMBERS = 32  # least members that make a node heavy
SHARD = 50_000  # chains that a shard holds, about
CHUNK = 2_000
WORDS = r"[^\x20\x09-\x0D]+"


def ordered_turns(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, depth, code, words): each turn's place in its conversation, from
    1, 128 bits of the digest of its role and text, and its text's words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = messages.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.substring(F.sha2(told, 256), 1, 32)).alias("code"),
        F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words"))
    # written first: finding the ranges reads it once more than sorting them
    turns = materialize(turns, "turns")
    return running_sums(turns, ["conv"], ["turn", "code"], {"depth": F.lit(1)}, "ordered-turns").select("conv", "depth", "code", "words")


def _digests(turns: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes (conv, a, b, a_before, b_before, ...) and their nodes without
    the root; raises if one digest stands for two prefixes."""
    lane = lambda k: F.xxhash64(F.lit(2 * seed + k), F.col("depth"), F.col("code"))
    prefixes = running_sums(turns, ["conv"], ["depth"], {"a": lane(0), "b": lane(1)}, "prefixes", before=True)
    same = ["depth", "code", "a_before", "b_before"]
    nodes = materialize(prefixes.groupBy("a", "b").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"_{c}") for c in same]), "nodes")
    clash = F.lit(False)
    for c in same:
        clash = clash | (F.col(c) != F.col(f"_{c}"))
    if nodes.where(clash | ((F.col("a") == 0) & (F.col("b") == 0))).limit(1).count():
        raise ValueError("two prefixes share a digest")
    return prefixes, nodes.select("a", "b", "conv", "n", "words", "depth", "a_before", "b_before")


def _verified_digests(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    for seed in range(4):
        try:
            return _digests(turns, seed)
        except ValueError:
            if seed == 3:
                raise
    raise AssertionError


def end_hashes(ends: DataFrame) -> DataFrame:
    """(a, b, first, sha): per node the smallest of the conversations that end
    there, and the SHA-256 of all of them, ascending and joined by commas."""
    kind = ends.schema["conv"].dataType.simpleString()

    def chunks(batches):
        for batch in batches:
            lanes = list(zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True))
            convs, texts = batch.column("conv").to_pylist(), batch.column("text").to_pylist()
            out = []
            for node, rows in groupby(range(len(lanes)), lanes.__getitem__):
                rows = list(rows)
                for k in range(0, len(rows), CHUNK):
                    part = rows[k:k + CHUNK]
                    out.append((*node, convs[part[0]], ",".join(texts[i] for i in part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*out, strict=True), [pa.int64(), pa.int64(), batch.schema.field("conv").type, pa.string()], strict=True)],
                    names=["a", "b", "conv", "text"])

    def hashes(batches):
        node, first, state, done = None, None, None, []
        for batch in batches:
            for a, b, conv, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv", "text")), strict=True):
                if (a, b) == node:
                    state.update(b"," + text.encode())
                else:
                    if node is not None:
                        done.append((*node, first, state.hexdigest()))
                    node, first, state = (a, b), conv, hashlib.sha256(text.encode())
            if done:
                yield made(done, batch)
                done = []
        if node is not None:
            yield made([(*node, first, state.hexdigest())], batch)

    def made(rows, like):
        types = [pa.int64(), pa.int64(), like.schema.field("conv").type, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          names=["a", "b", "first", "sha"])

    ranged = ends.select("a", "b", "conv", F.col("conv").cast("string").alias("text")) \
        .repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    parts = ranged.mapInArrow(lean(chunks), f"a bigint, b bigint, conv {kind}, text string")
    return materialize(parts.repartition("a", "b").sortWithinPartitions("a", "b", "conv").mapInArrow(
        lean(hashes), f"a bigint, b bigint, first {kind}, sha string"), "ends")


def add_up(slots: np.ndarray, parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> None:
    """Adds each slot's values to its parent's, deepest rows first; ``parent``
    is -1 where the parent is not in the table."""
    rows = np.flatnonzero(parent >= 0)
    rows = rows[np.argsort(-depth[rows], kind="stable")]
    for at in np.split(rows, np.flatnonzero(np.diff(depth[rows])) + 1):
        for v in values:
            np.add.at(v, parent[at], v[slots[at]])


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(table.column(name), False if name == "inside" else 0).combine_chunks().to_numpy(zero_copy_only=False)


def _chain_shard(table: pa.Table) -> pa.Table:
    """Subtree sums of the chains of whole units: (conv, above, at, saved, leaves)."""
    a, b, pa_, pb, start, end = (_ints(table, c) for c in ("a", "b", "up_a", "up_b", "start", "end"))
    inside = _ints(table, "inside").astype(bool)
    names = Slots(a, b)
    slot = names.find(a, b)
    parent = np.where(inside, names.find(pa_, pb), -1)
    if (parent[inside] < 0).any():
        raise ValueError("a chain's parent is not in its shard")
    saved, leaves, last = (np.zeros(len(a), np.int64) for _ in range(3))
    saved[slot], last[slot], leaves[:] = _ints(table, "saved"), end, 1
    leaves[parent[inside & (last[parent] == start - 1)]] = 0  # its last node has children
    add_up(slot, parent, start, saved, leaves)
    return pa.table({"conv": table.column("conv"), "above": table.column("above"), "at": pa.array(start - 1),
                     "saved": pa.array(saved[slot]), "leaves": pa.array(leaves[slot])})


def _heavy_table(table: pa.Table) -> pa.Table:
    """The heavy nodes' subtree sums: (a, b, saved, leaves, kids)."""
    a, b, pa_, pb, depth = (_ints(table, c) for c in ("a", "b", "a_before", "b_before", "depth"))
    names = Slots(a, b)
    slot = names.find(a, b)
    parent = np.where(depth > 0, names.find(pa_, pb), -1)
    saved, leaves, kids = (np.zeros(len(a), np.int64) for _ in range(3))
    saved[slot], leaves[slot], kids[slot] = (_ints(table, c) for c in ("saved", "leaves", "kids"))
    np.add.at(kids, parent[parent >= 0], 1)
    leaves[kids == 0] = 1
    add_up(slot, parent, depth, saved, leaves)
    return pa.table({"a": pa.array(a), "b": pa.array(b), "saved": pa.array(saved[slot]), "leaves": pa.array(leaves[slot]),
                     "kids": pa.array(kids[slot])})


def trie(turns: DataFrame, convs: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Nodes of the conversations ``turns`` (conv, depth, code, words), depth
    counting from 1 without gaps; ``convs`` (conv) has every conversation once,
    also those without turns.

    (a, b, conv, depth, parent_conv, n_convs, n_children, n_leaves, saved_words,
    first_end, ends_sha256); (a, b) is the prefix digest, 0 for the root."""
    prefixes, nodes = _verified_digests(turns)
    tails = prefixes.groupBy("conv").agg(F.max_by(F.struct("a", "b"), "depth").alias("at"))
    zero = F.lit(0).cast("bigint")
    ends = end_hashes(convs.join(tails, "conv", "left").select(
        F.coalesce("at.a", zero).alias("a"), F.coalesce("at.b", zero).alias("b"), "conv"))

    # a node's members are rows, so rows / members bounds the heavy nodes
    rows = nodes.agg(F.sum("n")).first()[0] or 0
    members = max(members, -(-rows // HEAVY))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0").select(
        zero.alias("a"), zero.alias("b"), "conv", "n", zero.alias("words"), zero.alias("depth"),
        F.lit(None).cast("bigint").alias("a_before"), F.lit(None).cast("bigint").alias("b_before"))
    heavy = materialize(nodes.where(F.col("n") > members).unionByName(root), "heavy")
    light = nodes.where(F.col("n") <= members)
    owned = heavy.select(F.col("a").alias("a_before"), F.col("b").alias("b_before"), F.col("conv").alias("above"))
    names = heavy.select("a", "b")
    pair = ["a_before", "b_before"]
    worth = ((F.col("n") - 1) * F.col("words")).alias("saved")

    # chains of light nodes, what they hang on, and the topmost light node above
    start = F.min_by(F.struct(*pair), "depth")
    chains = materialize(light.select("conv", "depth", *pair, worth).groupBy("conv").agg(
        F.min("depth").alias("start"), F.max("depth").alias("end"), F.sum("saved").alias("saved"), start.alias("up"))
        .select("conv", "start", "end", "saved", "up.*"), "chains")
    hung = chains.join(F.broadcast(owned), pair, "left")
    # at most `members` chains hang on a light node
    among = light.where("n > 1").select(F.col("a").alias("a_before"), F.col("b").alias("b_before"), F.col("conv").alias("above"))
    below = hung.where("above is null").drop("above").join(among, pair)
    cols = ["conv", "start", "end", "saved", "above"]
    placed = hung.where("above is not null").select(*cols, F.lit(False).alias("inside")).union(
        below.select(*cols, F.lit(True).alias("inside")))
    tops = prefixes.join(F.broadcast(names.toDF(*pair)), pair, "left_semi").join(F.broadcast(names), ["a", "b"], "left_anti") \
        .select("conv", F.xxhash64("a", "b").alias("unit"))
    shards = -(-(chains.count() or 1) // SHARD)
    lanes = lambda c, x, y: [F.xxhash64(F.lit(1), c).alias(x), F.xxhash64(F.lit(2), c).alias(y)]
    kind = turns.schema["conv"].dataType.simpleString()
    dealt = placed.join(tops, "conv").select(
        F.pmod("unit", F.lit(shards)).alias("shard"), *cols, "inside", *lanes("conv", "a", "b"), *lanes("above", "up_a", "up_b"))
    sums = materialize(dealt.groupBy("shard").applyInArrow(
        _chain_shard, f"conv {kind}, above {kind}, at bigint, saved bigint, leaves bigint"), "chain-sums")
    attached = materialize(sums.groupBy(F.col("above").alias("conv"), F.col("at").alias("depth")).agg(
        F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count(F.lit(1)).alias("kids")), "attached")
    more = [F.coalesce(c, zero) for c in ("more_saved", "more_leaves", "kids")]

    # heavy nodes: a bounded table of its own
    fed = heavy.join(attached, ["conv", "depth"], "left").select(
        F.lit(0).alias("one"), "a", "b", *pair, "depth", (worth + more[0]).alias("saved"), more[1].alias("leaves"), more[2].alias("kids"))
    top = fed.groupBy("one").applyInArrow(_heavy_table, "a bigint, b bigint, saved bigint, leaves bigint, kids bigint")
    out = ["a", "b", "conv", "depth", "above", "n", "kids", "leaves", "saved", "first", "sha"]
    heavies = heavy.join(owned, pair, "left").join(top, ["a", "b"]).join(ends, ["a", "b"], "left").select(*out)

    # light nodes: along their chains, from the end
    begun = sums.select("conv", (F.col("at") + 1).alias("depth"), F.col("above").alias("hung"))
    own = light.join(attached, ["conv", "depth"], "left").join(begun, ["conv", "depth"], "left").join(ends, ["a", "b"], "left")
    last = F.coalesce(F.col("first") == F.col("conv"), F.lit(False))  # its owner ends there
    own = own.select(
        "a", "b", "conv", "depth", (-F.col("depth")).alias("up"), F.coalesce("hung", "conv").alias("above"), "n",
        (more[2] + (~last).cast("bigint")).alias("kids"), (worth + more[0]).alias("_saved"),
        (more[1] + (last & (more[2] == 0)).cast("bigint")).alias("_leaves"), "first", "sha")
    lights = running_sums(own, ["conv"], ["up"], {"saved": F.col("_saved"), "leaves": F.col("_leaves")}, "subtrees").select(*out)
    none = hashlib.sha256(b"").hexdigest()
    return heavies.union(lights).select(
        "a", "b", "conv", "depth", F.col("above").alias("parent_conv"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_words"), F.col("first").alias("first_end"),
        F.coalesce("sha", F.lit(none)).alias("ends_sha256"))
