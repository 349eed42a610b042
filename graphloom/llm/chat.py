"""Multi-party chat formatting by rotating the perspective.

Every speaker of a conversation gets a rendering of the whole dialogue in which
that speaker is the assistant and all others are named users; system messages stay
what they are.  The mask lists the ranges of characters that the speaker said, its
end marker included, which are those to learn from.

The whole dialogue is one rendering, in the order of turn, role and text.  It is laid
down in parts of `limit` consecutive messages, so that a conversation that holds a third of
all rows is many rows of bounded size: part 0 is its first messages, part 1 the next, and so on,
`start` is where a part begins in the rendering, and masks count from the beginning
of the dialogue.  The parts' texts end to end are the rendering; nothing else depends on where they are cut.

Ranks come from ranges of all messages sorted apart plus what earlier ranges have, starts
from sums over parts in two levels, and speakers meet parts under salted keys, so no task
sees a whole conversation.

Cases: messages of equal turn are ordered by role and text, nulls first; a row
that repeats conversation, turn, role and text is the same message; null turns come first;
a null text is empty; a text of any length is one message; a null role is a user without a
name and no perspective; a null conversation is one of its own; one that has only
system messages gives no rows, as does an empty table; further columns, whatever they are
called, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import written

LIMIT = 256  # messages in a part
SALTS, SUPER = 16, 1024
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"


def _head(role: Column, me: Column) -> Column:
    who = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == me, F.lit("assistant")).when(role.isNull(), F.lit("user")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), who, F.lit("\n"))


def _ordered(rows: DataFrame, limit: int) -> DataFrame:
    """The rows with their part, by rank in (turn, role, text) order.

    Ranges of all rows are sorted apart; the rank is that in the range plus what earlier ranges have of the conversation.
    """
    key = ["conv_id", "turn", "role", "text"]
    ranges = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranges = written(ranges)  # ranges are drawn from a sample: they must not be drawn twice
    conv = Window.partitionBy("c").orderBy("r")
    have = ranges.groupBy(F.col("conv_id").alias("c"), F.col("range").alias("r")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    have = have.withColumn("before", F.coalesce(F.sum("n").over(conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranges.join(have, ranges.conv_id.eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return ranked.select(*key, F.floor((F.col("before") + F.col("at") - F.col("first")) / limit).alias("part"))


def _starts(said: DataFrame) -> DataFrame:
    """c, p, perspective, start: where each part begins in each speaker's rendering."""
    size = F.length(_head(F.col("role"), F.lit(None).cast("string"))) + F.length("text") + len(END) + 1
    narrow = said.select("conv_id", "part", "role", size.alias("size"))
    parts = narrow.groupBy("conv_id", "part").agg(F.sum("size").alias("size")).withColumn("salt", F.pmod("part", F.lit(SALTS)))
    spoken = narrow.filter((F.col("role") != SYSTEM) & F.col("role").isNotNull()).groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("role").alias("perspective")).agg(F.count("*").alias("own"))
    speakers = spoken.select(F.col("c").alias("k"), "perspective").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = parts.join(speakers, parts.conv_id.eqNullSafe(speakers.k) & (parts.salt == speakers.salt)).select("conv_id", "part", "size", speakers.perspective.alias("me"))
    each = each.join(spoken, each.conv_id.eqNullSafe(spoken.c) & (F.col("part") == F.col("p")) & (F.col("me") == F.col("perspective")), "left")
    less = F.length(F.concat(F.lit("user name="), F.col("me"))) - len("assistant")  # characters that each own message is shorter by
    each = each.select("conv_id", "part", "me", (F.col("size") - F.coalesce("own", F.lit(0)) * less).alias("size"), F.floor(F.col("part") / SUPER).alias("super"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = each.groupBy(F.col("conv_id").alias("c"), F.col("me").alias("m"), F.col("super").alias("s")).agg(F.sum("size").alias("size"))
    total = total.select("c", "m", "s", F.coalesce(F.sum("size").over(before(("c", "m"), "s")), F.lit(0)).alias("earlier"))
    inner = each.withColumn("within", F.coalesce(F.sum("size").over(before(("conv_id", "me", "super"), "part")), F.lit(0)))
    out = inner.join(total, inner.conv_id.eqNullSafe(total.c) & (inner.me == total.m) & (inner.super == total.s))
    return out.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("me").alias("perspective"), (F.col("earlier") + F.col("within")).alias("start"))


def rotate(messages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, perspective, part, start, n_messages, n_chars, n_trained, text and mask ("start-end,...") of every part for every speaker."""
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    said = written(_ordered(rows, limit))
    starts = _starts(said)
    parts = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))  # `limit` at most
    each = parts.join(starts, parts.conv_id.eqNullSafe(starts.c) & (parts.part == starts.p)).drop("c", "p")
    me = F.col("perspective")
    pieces = F.transform("said", lambda s: F.struct(_head(s["role"], me).alias("head"), F.concat(s["text"], F.lit(END)).alias("body"), F.coalesce(s["role"] == me, F.lit(False)).alias("mine")))
    each = each.withColumn("pieces", pieces)
    empty = F.struct(F.col("start").cast("long").alias("at"), F.lit(0).cast("long").alias("trained"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), (acc["trained"] + F.when(s["mine"], F.length(s["body"])).otherwise(0)).alias("trained"), F.when(s["mine"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    each = each.withColumn("m", F.aggregate("pieces", empty, step))
    text = F.array_join(F.transform("pieces", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    return each.select("conv_id", "perspective", "part", F.col("start").cast("long").alias("start"), F.size("said").cast("long").alias("n_messages"), (F.col("m.at") - F.col("start")).cast("long").alias("n_chars"), F.col("m.trained").alias("n_trained"), text.alias("text"), F.array_join("m.spans", ",").alias("mask"))


#: The same from the definition: ranks and offsets by windows over whole dialogues.
SQL = f"""
with d as (select distinct conv_id, turn, role, coalesce(text, '') as text from conversations),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text) as k from d),
p as (select distinct conv_id, role as perspective from r where role <> '{SYSTEM}'),
s as (select r.conv_id, perspective, k, (k - 1) // {LIMIT} as part, '{START}' || case when role = '{SYSTEM}' then role when role = perspective then 'assistant' when role is null then 'user' else 'user name=' || role end || chr(10) as head,
  text || '{END}' as body, coalesce(role = perspective, false) as mine from r join p on r.conv_id is not distinct from p.conv_id),
o as (select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, perspective order by k rows between unbounded preceding and 1 preceding), 0)::bigint as a from s)
select conv_id, perspective, part, min(a) as start, count(*) as n_messages, sum(length(head) + length(body) + 1)::bigint as n_chars, coalesce(sum(length(body)) filter (mine), 0)::bigint as n_trained,
  string_agg(head || body || chr(10), '' order by k) as text, coalesce(string_agg((a + length(head)) || '-' || (a + length(head) + length(body)), ',' order by k) filter (mine), '') as mask
from o group by conv_id, perspective, part
"""
