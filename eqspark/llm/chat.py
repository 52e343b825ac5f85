"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, once for each turn it grew by. Every turn gets a hash of its place, role
and text; the running sum of these is the hash of the prefix up to that turn (two independent 64-bit sums), so the
hash of a whole conversation is a prefix hash of each longer one that continues it. An anti-join against the
prefix hashes of other conversations keeps maximal ones, and of equal ones the smallest conv_id. Then turns are
rendered in a role-marked template, as one row a turn: ``rendered`` joined in ``position`` order is the conversation.

The running sum is taken in blocks of ``TURN_BLOCK`` turn numbers and then over block totals, so a conversation with a
third of all turns is spread over many tasks. Only its rows of equal turn numbers (or of none) are ordered in one task, by a window that spills.

Edge cases: rows with a null conv_id take no part; a null turn comes first; repeated (conv_id, turn) rows are ordered by
role and text; repeated whole rows count as turns; a null role renders as ``unknown`` and a null text as empty, and each hashes apart
from the empty string; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TURN_BLOCK = 4096
#: Fixed marks of the template.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text, h1, h2: hashes of the conversation up to and with this turn."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    block = F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-(2**60))).cast("long")
    own = turns.withColumns({"_block": block, "_digest": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)})
    inner = Window.partitionBy("conv_id", "_block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").isNotNull(), "_digest")
    own = own.withColumn("_at", F.row_number().over(inner).cast("long"))
    # places before each block: sums over the few blocks of a conversation
    blocks = materialize(own.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("n")), "chat-blocks")
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = own.join(starts, ["conv_id", "_block"]).withColumn("position", F.col("_start") + F.col("_at") - 1)
    mark = [F.col("position"), F.coalesce(F.col("role"), F.lit("\x00")), F.col("text").isNull(), F.coalesce(F.col("text"), F.lit(""))]
    half = {f"e{k}": F.xxhash64(F.lit(k), *mark).bitwiseAND(F.lit((1 << 62) - 1)) for k in (1, 2)}
    placed = placed.withColumns(half)
    # sums modulo 2^61: long sums of 62-bit values overflow, so they go by way of decimals
    totals = placed.groupBy("conv_id", "_block").agg(*[F.sum(F.col(f"e{k}").cast("decimal(20,0)")).alias(f"t{k}") for k in (1, 2)])
    totals = totals.withColumns({f"t{k}": F.coalesce(F.sum(f"t{k}").over(before), F.lit(0)) for k in (1, 2)})
    run = Window.partitionBy("conv_id", "_block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.join(totals, ["conv_id", "_block"])
    sums = sums.withColumns({f"h{k}": ((F.sum(F.col(f"e{k}").cast("decimal(20,0)")).over(run) + F.col(f"t{k}")) % F.lit(1 << 61)).cast("long") for k in (1, 2)})
    return sums.select("conv_id", "position", "role", "text", "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of conversations that are neither a prefix of a longer one nor a repeat of one with a smaller conv_id. ``turns``: prefixes' rows."""
    sizes = turns.groupBy("conv_id").agg(F.max("position").alias("last"))
    marks = turns.select("conv_id", "position", "h1", "h2").join(sizes, "conv_id").withColumn("whole", F.col("position") == F.col("last"))
    key = ["position", "h1", "h2"]
    # a prefix that thousands share is one row here
    longer = marks.where("NOT whole").groupBy(*key).agg(F.lit(True).alias("x")).drop("x")
    ends = marks.where("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    return ends.join(longer, key, "left_anti").select("conv_id", (F.col("position") + 1).alias("n_turns"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, position, n_turns, role, rendered of every turn of the maximal conversations."""
    turns = materialize(prefixes(conversations), "chat-turns")
    kept = maximal(turns)
    role = F.coalesce("role", F.lit("unknown"))
    rendered = F.concat(F.lit(OPEN), role, F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    return turns.join(kept, "conv_id").select("conv_id", "position", "n_turns", role.alias("role"), rendered.alias("rendered"))


ORACLE_SQL = f"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text IS NOT NULL, sha256(coalesce(text, ''))) - 1 AS position, role, text
    FROM conversations WHERE conv_id IS NOT NULL
), p AS (
    SELECT conv_id, position, role, text,
           md5(string_agg(md5(concat_ws('|', coalesce(role, chr(0)), CAST(text IS NULL AS VARCHAR), coalesce(text, ''))), ',') OVER w) AS h
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING)
), n AS (SELECT conv_id, max(position) AS last FROM p GROUP BY conv_id),
m AS (SELECT p.conv_id, p.position, p.h, p.position = n.last AS whole FROM p JOIN n USING (conv_id)),
k AS (
    SELECT min(conv_id) AS conv_id, position + 1 AS n_turns FROM m
    WHERE whole AND NOT EXISTS (SELECT 1 FROM m AS o WHERE NOT o.whole AND o.position = m.position AND o.h = m.h)
    GROUP BY position, h
)
SELECT conv_id, position, n_turns, coalesce(role, 'unknown') AS role, concat('{OPEN}', coalesce(role, 'unknown'), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)) AS rendered
FROM p JOIN k USING (conv_id)
"""
