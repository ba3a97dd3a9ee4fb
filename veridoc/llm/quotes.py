"""Quotation linking: messages with nested quotes become reply-ordered conversations without quotes.

Lines are read by quote level, runs of one level are passages, and normalised passages are hashed. A quoted passage, or else
one of its lines, is joined to the first earlier message that wrote it, within the scope of the message if it can. What a
message answers is the source of its shallowest linked quote; threads are found by pointer doubling. Everything is DataFrame
and SQL functions; a message is parsed inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veridoc.llm.common import store
from veridoc.operators.ranking import rank_in_group

# A quote mark at the start of a line, and a line that introduces a quote (fixed words of four languages).
_MARKS = r"^(?:[ \t]{0,3}>)+"
_INTRO = r"(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|a écrit|escribió)\s*:\s*$"


def normal(text: Column) -> Column:
    """Lower-cased, with each run of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """Add `runs`, an array of (level, lines) in order: level 0 is the message's own text; empty runs are left out.

    A line that introduces a quote belongs to no run if the next line is quoted deeper.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), r"\r?\n")
    parsed = messages.withColumn("lines", F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), r"[^>]", "")).alias("level"),
        F.regexp_replace(x, _MARKS, "").alias("line"))))
    after = F.col("lines")
    kept = parsed.withColumn("lines", F.filter(F.transform(after, lambda x, i: F.struct(
        x["level"].alias("level"), x["line"].alias("line"),
        (x["line"].rlike(_INTRO) & (F.coalesce(F.try_element_at(after, i + 2)["level"], F.lit(0)) > x["level"])).alias("intro"))),
        lambda x: ~x["intro"]))
    cuts = F.filter(F.sequence(F.lit(0), F.size("lines")), lambda i: (i == 0) | (i == F.size("lines")) | (
        F.try_element_at(F.col("lines"), i + 1)["level"] != F.try_element_at(F.col("lines"), F.greatest(i, F.lit(1)))["level"]))
    marked = kept.withColumn("cuts", F.array_distinct(cuts))
    spans = F.transform(F.slice("cuts", 1, F.greatest(F.size("cuts") - 1, F.lit(0))), lambda c, k: F.struct(
        F.element_at("lines", c + 1)["level"].alias("level"),
        F.transform(F.slice("lines", c + 1, F.element_at("cuts", k + 2) - c), lambda x: x["line"]).alias("lines")))
    runs = F.when(F.size("lines") > 0, spans).otherwise(F.expr("array()").cast("array<struct<level:int,lines:array<string>>>"))
    return marked.withColumn("runs", F.filter(runs, lambda r: F.array_join(r["lines"], "").rlike(r"\S"))).drop("lines", "cuts")


def _units(parsed: DataFrame) -> DataFrame:
    """(id, scope, level, run, kind, hash): kind 0 is a whole passage, kind 1 a line of one with several."""
    runs = parsed.select("id", "scope", F.posexplode("runs").alias("run", "r"))
    texts = F.concat(F.array(F.struct(F.lit(0).alias("kind"), normal(F.array_join("r.lines", " ")).alias("t"))),
                     F.when(F.size("r.lines") > 1, F.transform("r.lines", lambda x: F.struct(F.lit(1).alias("kind"), normal(x).alias("t"))))
                     .otherwise(F.expr("array()").cast("array<struct<kind:int,t:string>>")))
    units = runs.select("id", "scope", "run", F.col("r.level").alias("level"), F.explode(texts).alias("u"))
    return units.filter("u.t <> ''").select("id", "scope", "run", "level", "u.kind", F.sha2(F.col("u.t").cast("binary"), 256).alias("hash"))


def link_quotes(messages: DataFrame, key: list[str], text: str = "text", scope: str | None = None) -> DataFrame:
    """One row per row of `messages`: its key columns, own_text, n_quotes, n_linked, and parent, thread, depth, place.

    `key` names the columns that order messages; a parent has a smaller key than its replies, so no circle arises. Of
    several sources of a quote, one in the same `scope` and then the first by key is taken; a whole passage goes before a
    line. parent is null for a message that answers none, which starts a thread (depth 0); place numbers a thread's messages
    by depth, then key. Null texts are empty messages; a null in a key sorts first and is a value like others; rows that
    repeat a key are one message with all their quotes, each row with its own text and the place of its key. Whole texts are
    read; other columns are not. An empty table gives an empty one.
    """
    ident = F.struct(*(F.col(f"`{k}`") for k in key))
    source = messages.select(ident.alias("id"), (F.col(f"`{scope}`").cast("string") if scope else F.lit(None).cast("string")).alias("scope"),
                             F.col(f"`{text}`").cast("string").alias("text"))
    parsed = store(passages(source), "messages")
    units = store(_units(parsed), "passages")
    own = units.filter("level = 0")
    anywhere = store(own.groupBy("hash").agg(F.min("id").alias("first")), "sources")
    nearby = store(own.filter("scope is not null").groupBy("scope", "hash").agg(F.min("id").alias("first_here")), "sources-in-scope")
    quoted = units.filter("level > 0").join(anywhere, "hash", "left").join(nearby, ["scope", "hash"], "left")
    here = F.col("first_here").isNotNull() & (F.col("first_here") < F.col("id"))
    there = F.col("first").isNotNull() & (F.col("first") < F.col("id"))
    found = quoted.withColumn("to", F.when(here, F.struct("level", "kind", F.lit(0).alias("far"), F.col("first_here").alias("of")))
                              .when(there, F.struct("level", "kind", F.lit(1).alias("far"), F.col("first").alias("of"))))
    per_run = found.groupBy("id", "run").agg(F.min("to").alias("to"))
    answers = per_run.groupBy("id").agg(F.min("to").alias("to"), F.count("*").alias("n_quotes"), F.count("to").alias("n_linked"))
    ids = parsed.select("id").distinct()
    heads = store(ids.join(answers, "id", "left").select("id", F.col("to.of").alias("parent"), F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"),
                                                         F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked")), "heads")
    # Each round doubles the way up: `up` is an ancestor `steps` above. Messages that have reached their root, which points to
    # itself, are set aside, so a few long threads keep only their own messages busy.
    start = F.col("parent").isNull().alias("at_root")
    ways = store(heads.select("id", F.coalesce("parent", "id").alias("up"), F.col("parent").isNotNull().cast("long").alias("steps"), start), "ways")
    reached, moving = ways.filter("at_root"), ways.filter("not at_root")
    while not moving.isEmpty():
        upper = reached.union(moving).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), "at_root")
        further = store(moving.drop("at_root").join(upper, "up").select(
            "id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), "at_root"), "ways")
        reached, moving = reached.union(further.filter("at_root")), further.filter("not at_root")
    ways = reached.drop("at_root")
    threads = store(heads.join(ways, "id").select("id", "parent", "n_quotes", "n_linked", F.col("up").alias("thread"), F.col("steps").alias("depth")), "threads")
    placed = rank_in_group(threads, ["thread"], [F.col("depth"), F.col("id")], "place")
    own_text = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: F.regexp_replace(F.array_join(r["lines"], "\n"), r"^\s+|\s+$", "")), "\n")
    return parsed.select("id", own_text.alias("own_text")).join(store(placed, "placed"), "id").select(
        *(F.col(f"id.`{k}`").alias(k) for k in key), "own_text", "n_quotes", "n_linked", "parent", "thread", "depth", "place")
