"""Chat formatting from reply trees (operator 9), DataFrame functions only.

`paths` enumerates root-to-leaf paths of a forest of messages by iterative
self-joins that double their reach, ranks the branches of a root by score, and
`formatted` writes each chosen path as one conversation.

Template of a turn: `### ` role `: ` text `</turn>` newline. Inside roles and
texts `&`, `#` and `<` are written `&amp;`, `&num;` and `&lt;`, and `:` inside
roles `&colon;`, so that marks occur only as marks and reading back is exact.

Defined results: a null text or role is empty; null turns come first; rows that
share a turn follow one another, ordered by role and text; a message whose parent
is null, absent or the message itself is a root; equal scores prefer the smaller
leaf id; an empty table gives no rows; other columns are ignored. Messages on a
cycle reach no root and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackfold.llm.common import checkpointed, table

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("#"), F.lit("&num;")), F.lit("<"), F.lit("&lt;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&num;"), F.lit("#")), F.lit("&colon;"), F.lit(":")), F.lit("&amp;"), F.lit("&"))


def chained(messages: DataFrame) -> DataFrame:
    """Messages in turn order as a chain of replies: conv_id, node, parent, role, text, score."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order))
    node = lambda at: F.struct(F.col("conv_id").alias("conv"), at.cast("bigint").alias("at"))
    return rows.select("conv_id", node(F.col("at")).alias("node"), F.when(F.col("at") > 1, node(F.col("at") - 1)).alias("parent"), "role", "text", F.char_length("text").cast("double").alias("score"))


def paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """messages: node, parent, role, text, score. The `keep` best branches of each root, a row per message: root, leaf, branch (1 is best), depth (0 at the root), node, role, text. A branch scores the sum over its messages.

    Round k of the first loop joins each node to its ancestor 2**k above, adding up scores and depth; round k of the second extends the chosen leaves' paths by as much. Rounds are the logarithm of the deepest path, and texts take no part until the end."""
    m = checkpointed(messages.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    known = m.select(F.col("node").alias("parent"))
    linked = m.where("not parent <=> node").join(known, "parent", "left_semi")
    up = checkpointed(m.join(linked.select("node", F.col("parent").alias("up")), "node", "left").select("node", "up", "score", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.coalesce("up", "node").alias("top")))
    jumps = [up.where("up is not null").select("node", "up")]
    rounds, nodes = 0, m.count()
    while True:
        open_ = up.where("up is not null")
        if open_.isEmpty():
            break
        if 1 << rounds >= nodes:  # no path is so long: only cycles are left
            up = up.where("up is null")
            break
        rounds += 1
        far = up.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"), F.col("top").alias("top2"))
        # an ancestor that has reached its root carries the sum over the rest of the way
        # only nodes still on their way take part in a round
        up = checkpointed(up.where("up is null").unionByName(open_.join(far, "up").select("node", F.col("up2").alias("up"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("top2", "top").alias("top"))))
        jumps.append(up.where("up is not null").select("node", "up"))
    leaves = up.join(linked.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    best = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("top").orderBy(F.desc("score"), "node"))).where(F.col("branch") <= keep)
    on = checkpointed(best.select(F.col("top").alias("root"), F.col("node").alias("leaf"), "branch", "depth", "node"))
    for k, jump in enumerate(jumps):
        above = on.join(jump, "node").select("root", "leaf", "branch", (F.col("depth") - F.lit(2**k)).alias("depth"), F.col("up").alias("node"))
        on = checkpointed(on.union(above))
    return on.join(messages.select("node", "role", "text"), "node").select("root", "leaf", "branch", "depth", "node", "role", "text")


def formatted(path: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: root, leaf, branch, formatted, spans. spans is the loss mask: start (from 0) and length in code points of each stretch of text of the role `learn`."""
    turn = F.struct("depth", F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("&colon;")), F.lit(ROLE_END)).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == learn).alias("learn"))
    one = path.groupBy("root", "leaf", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    one = one.withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(CLOSE))), ""))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        at = acc.at + F.char_length(t.head)
        length = F.char_length(t.body).cast("bigint")
        return F.struct((at + length + len(CLOSE)).alias("at"), F.when(t.learn, F.concat(acc.spans, F.array(F.struct(at.alias("start"), length.alias("length"))))).otherwise(acc.spans).alias("spans"))

    return one.select("root", "leaf", "branch", "formatted", F.aggregate("turns", start, step, lambda a: a.spans).alias("spans"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, then read back from the formatted string and its mask."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    out = formatted(paths(chained(rows.unionByName(extra))))
    # what is written splits at the marks, which texts cannot hold
    bits = F.split("formatted", CLOSE, -1)
    turns = F.transform(F.slice(bits, 1, F.size(bits) - 1), lambda t: F.concat(unescaped(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), ROLE_END, 1)), F.lit("\n"), unescaped(F.substr(t, F.instr(t, ROLE_END) + len(ROLE_END))), F.lit("\n")))
    masked = F.array_join(F.transform("spans", lambda s: unescaped(F.substr("formatted", (s.start + 1).cast("int"), s.length.cast("int")))), "")
    out = out.select(F.col("leaf.conv").alias("conv_id"), "formatted", F.size(bits).alias("n"), F.array_join(turns, "").alias("turns"), masked.alias("loss"))
    return out.select("conv_id", (F.col("n") - 1).cast("bigint").alias("n_turns"), F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))


_E = "replace(replace(replace({}, '&', '&amp;'), '#', '&num;'), '<', '&lt;')"
OP9_SQL = rf"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g as (
  select conv_id, count(*)::bigint as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
    sum(4 + length({_E.format("role")}) + 2 + length({_E.format("text")}) + 8)::bigint as formatted_chars
  from r group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""
