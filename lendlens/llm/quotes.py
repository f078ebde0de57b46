"""Quotation linking for chat formatting (operator 8), in DataFrame
expressions only.

A message's lines are parsed into nested quote levels (the number of ``>``
before the text).  Runs of lines of one level are passages.  Lines stay as
they are written; what is hashed is a normalised copy.  Normalised
passages and their lines are hashed and joined to the own (level 0) lines,
paragraphs and whole texts of earlier messages of the conversation; each
meets the latest earlier message that has it.  A message replies to the
original of its outermost linked passages that covers most characters (then
the later one); a message that quotes nothing known replies to the turn before.

The conversation is the forest of these replies in preorder, later replies to
one message after earlier ones.  Messages that follow the turn before form
runs, and a run is placed by the path of its branchings, so ``path`` grows
with how deep the branching is, not with the conversation's length; rows
sorted by (conv_id, path, turn) are the conversation in reply order.

"The latest earlier" is taken in two steps, inside blocks of turns and over
block totals, so a conversation or a line that a third of all rows share is
not one task's work.

Nulls: a null text has no lines; rows with a null conversation or turn are
kept, linked with nothing.  A conversation's id keeps its type; a turn that is
no whole number counts as null.  Rows repeated under one turn are parsed each; they
are one node of the forest.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lendlens.sources.tables import materialize

MARKS = r"^(?:[ \t]*>)+"
TURNS = 1024  # turns in a block


def parsed_lines(text: Column) -> Column:
    """Lines of a text as (level, line); the line as it is written."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda s: F.struct(
        F.regexp_count(F.regexp_extract(s, MARKS, 0), F.lit(">")).cast("int").alias("level"), s.alias("line")))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, without outer blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(lines: Column) -> Column:
    """Runs of lines of one level: (level, place of the first line, lines)."""
    kind = "array<struct<level:int,at:int,lines:array<string>>>"
    head = lambda acc: F.slice(acc, 1, F.size(acc) - 1)
    last = lambda acc: F.element_at(acc, -1)
    one = lambda x: F.struct(x["level"].alias("level"), x["at"].alias("at"), F.array(x["line"]).alias("lines"))
    placed = F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), i.alias("at"), x["line"].alias("line")))
    return F.aggregate(placed, F.array().cast(kind), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["level"] == x["level"]),
        F.concat(head(acc), F.array(F.struct(
            last(acc)["level"].alias("level"), last(acc)["at"].alias("at"),
            F.concat(last(acc)["lines"], F.array(x["line"])).alias("lines")))))
        .otherwise(F.concat(acc, F.array(one(x)))))


def own_lines(lines: Column) -> Column:
    """The level-0 lines as they are written, without blank lines at either end."""
    kept = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"])
    full = F.filter(F.transform(kept, lambda s, i: F.when(s.rlike(r"\S"), i)), lambda i: i.isNotNull())
    first, last = F.array_min(full), F.array_max(full)
    return F.coalesce(F.slice(kept, first + 1, last - first + 1), F.array().cast("array<string>"))


def own_text(lines: Column) -> Column:
    return F.array_join(own_lines(lines), "\n")


def unmarked(line: Column) -> Column:
    """A quoted line as its units have it."""
    return normalised(F.regexp_replace(line, MARKS, ""))


def _units(bodies: Column) -> Column:
    """Normalised non-empty lines and their whole, distinct."""
    whole = F.array(normalised(F.array_join(bodies, " ")))
    return F.array_distinct(F.filter(F.concat(whole, F.transform(bodies, normalised)), lambda x: x != ""))


def unlinked_lines(lines: Column, found: Column) -> Column:
    """(line, text) of the quoted lines that no earlier message has, neither
    alone nor with their whole passage; ``found`` are the linked units."""
    has = lambda unit: F.coalesce(F.array_contains(found, F.md5(unit)), F.lit(False))
    whole = lambda p: normalised(F.array_join(F.transform(p["lines"], unmarked), " "))
    lost = F.filter(passages(lines), lambda p: (p["level"] > 0) & ~has(whole(p)))
    each = F.flatten(F.transform(lost, lambda p: F.transform(
        p["lines"], lambda s, i: F.struct((p["at"] + i).alias("line"), s.alias("text")))))
    none = F.array().cast("array<struct<line:int,text:string>>")
    return F.when(F.exists(lines, lambda x: x["level"] > 0), F.filter(
        each, lambda x: (unmarked(x["text"]) != "") & ~has(unmarked(x["text"])))).otherwise(none)


def last_before(rows: DataFrame, keys: list[str], turn: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` of the rows with the same keys
    and a smaller turn."""
    blocked = rows.withColumn("_block", F.floor(F.col(turn) / TURNS))
    totals = blocked.groupBy(*keys, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(turn))).alias("_carry"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(totals.withColumn("_carry", F.last("_carry", ignorenulls=True).over(over)), "carried")
    same = [blocked[k].eqNullSafe(carried[k]) for k in [*keys, "_block"]]
    near = Window.partitionBy(*keys, "_block").orderBy(turn).rangeBetween(Window.unboundedPreceding, -1)
    inside = blocked.withColumn("_near", F.last(value, ignorenulls=True).over(near))
    cond = same[0]
    for c in same[1:]:
        cond &= c
    return inside.join(carried, cond, "left").select(
        *[inside[c] for c in rows.columns], F.coalesce("_near", "_carry").alias(out))


def link_replies(messages: DataFrame, across_gaps: bool = False) -> DataFrame:
    """(conv, turn, previous, reply_to, quotes, linked, found) per distinct (conv, turn);
    ``messages`` has (conv, turn, lines), ``found`` are the hashes of the
    quoted units that an earlier message has."""
    known = messages.where("conv is not null and turn is not null")
    own = own_lines(F.col("lines"))
    paragraphs = F.transform(F.split(own_text(F.col("lines")), r"\n\s*\n"), normalised)
    originals = known.select("conv", "turn", F.explode(F.array_distinct(F.filter(
        F.concat(_units(own), paragraphs), lambda x: x != ""))).alias("unit")).select(
        "conv", F.md5("unit").alias("unit"), "turn", F.col("turn").alias("has"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("int").alias("passage"))
    quoted = known.select("conv", "turn", F.posexplode(passages(F.col("lines"))).alias("passage", "p")).where("p.level > 0") \
        .select("conv", "turn", "passage", "p.level", F.explode(_units(F.transform("p.lines", unmarked))).alias("unit")).select(
        "conv", F.md5("unit").alias("unit"), "turn", F.lit(None).cast("bigint").alias("has"), "level",
        F.length("unit").cast("bigint").alias("size"), "passage")
    # units that nobody quotes need not be searched
    asked = quoted.select("conv", "unit").distinct()
    searched = originals.join(asked, ["conv", "unit"], "left_semi").unionByName(quoted)
    met = last_before(materialize(searched, "units"), ["conv", "unit"], "turn", "has", "original").where("level is not null")
    per_original = met.where("original is not null").groupBy("conv", "turn", "level", "original").agg(F.sum("size").alias("size"))
    best = per_original.groupBy("conv", "turn").agg(
        F.max(F.struct(-F.col("level"), "size", "original"))["original"].alias("quoted"))
    counts = met.groupBy("conv", "turn").agg(
        F.countDistinct("passage").alias("quotes"),
        F.countDistinct(F.when(F.col("original").isNotNull(), F.col("passage"))).alias("linked"),
        F.collect_set(F.when(F.col("original").isNotNull(), F.col("unit"))).alias("found"))
    # the turn before; across gaps, whatever the numbers between
    turns = last_before(known.select("conv", "turn").distinct().withColumn("own", F.col("turn")), ["conv"], "turn", "own", "previous")
    if not across_gaps:
        turns = turns.withColumn("previous", F.when(F.col("previous") == F.col("turn") - 1, F.col("previous")))
    return turns.join(best, ["conv", "turn"], "left").join(counts, ["conv", "turn"], "left").select(
        "conv", "turn", "previous", F.coalesce("quoted", "previous").alias("reply_to"),
        F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("linked", F.lit(0)).alias("linked"), "found")


def reply_paths(links: DataFrame) -> DataFrame:
    """(conv, turn, path): for each message the branchings that lead to its
    run, as (-place of the branching, first turn of the run)."""
    follows = F.coalesce(F.col("reply_to") == F.col("previous"), F.lit(False))
    marked = links.select("conv", "turn", "reply_to", F.when(~follows, F.col("turn")).alias("head"))
    headed = last_before(marked, ["conv"], "turn", "head", "run_before") \
        .select("conv", "turn", "reply_to", "head", F.coalesce("head", "run_before").alias("run"))
    headed = materialize(headed, "runs")
    step = F.array(F.struct((-F.coalesce("reply_to", F.lit(-1))).alias("at"), F.col("turn").alias("head")))
    heads = headed.where("head is not null").select("conv", F.col("turn").alias("run"), "reply_to", step.alias("path"))
    over = headed.select("conv", F.col("turn").alias("reply_to"), F.col("run").alias("up"))
    paths = materialize(heads.join(over, ["conv", "reply_to"], "left").select("conv", "run", "up", "path"), "paths")
    # doubling: a run's path so far, put behind that of the run above
    while paths.where("up is not null").limit(1).count():
        above = paths.select("conv", F.col("run").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        paths = materialize(paths.join(above, ["conv", "up"], "left").select(
            "conv", "run", F.col("next").alias("up"), F.when(F.col("before").isNull(), F.col("path"))
            .otherwise(F.concat("before", "path")).alias("path")), "paths")
    return headed.join(paths.select("conv", "run", "path"), ["conv", "run"]).select("conv", "turn", "path")


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", across_gaps: bool = False) -> DataFrame:
    """One row per message: (conv, turn, role, text without quotes, reply_to,
    quotes, linked, unlinked, path); sort by (conv, path, turn) to read in
    reply order.  ``unlinked`` has the lines that begin with ``>`` and quote
    nothing known, as (line, text), so that none is lost.  With ``across_gaps``
    the turn before is the last one there is, else only the one numbered one less."""
    src = materialize(messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).try_cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"), parsed_lines(F.col(text_col).cast("string")).alias("lines")), "messages")
    links = materialize(link_replies(src, across_gaps), "replies")
    placed = links.drop("previous").join(reply_paths(links), ["conv", "turn"])
    return src.join(placed, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col),
        own_text(F.col("lines")).alias(text_col), "reply_to",
        F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("linked", F.lit(0)).alias("linked"),
        unlinked_lines(F.col("lines"), F.col("found")).alias("unlinked"), "path")
