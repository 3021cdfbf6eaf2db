"""Chat logs to training texts: collapse of cumulative snapshots, then rendering.

A client that logs a conversation after every turn leaves snapshots that are
prefixes of one another. A rolling hash per turn prefix finds them: the hash of a
whole conversation equals a prefix hash of each longer one that continues it. Two
anti-joins on distinct hashes leave the maximal conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framecloud.functions.order import dense_index

#: Turns in one rendered part; a longer conversation is several parts.
PART_TURNS = 64
#: Turn numbers ranked together.
SLICE = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(chats: DataFrame) -> DataFrame:
    """conv_id, pos (0-based) and both halves of a digest per turn.

    Turns are ordered by number, equal numbers by role and text; a null turn comes
    first, a null role reads ``unknown`` and a null text is empty. Positions are
    counted in slices of turn numbers, so one endless conversation is many tasks.
    """
    role, text = said()
    rows = chats.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**62))).alias("turn"),
        F.md5(F.concat_ws("\n", role, text)).alias("said"),
        role.alias("role"),
        text.alias("text"),
    )
    return rows


def said() -> tuple[Column, Column]:
    return (
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")),
        F.coalesce(F.col("text").cast("string"), F.lit("")),
    )


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """conv_id, pos, n and the 128-bit rolling hash (h1, h2) of turns 0 to pos.

    Every turn hashes with its position and prefixes combine by exclusive or, which
    sums in any order: a running value inside a slice, shifted by the slices before.
    """
    keyed = rows.select("conv_id", "turn", "said", F.coalesce("conv_id", F.lit(-(2**62))).alias("_c"))
    placed = dense_index(keyed, ["_c"], ["turn", "said"], SLICE, "pos")
    digest = F.md5(F.concat_ws("|", F.col("pos").cast("string"), "said"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    terms = placed.select("_c", "conv_id", "pos", half(1).alias("t1"), half(16).alias("t2"), F.expr(f"pos div {SLICE}").alias("_s"))
    inside = W.partitionBy("_c", "_s").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("_c").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    slices = terms.groupBy("_c", "_s").agg(
        F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"), F.count(F.lit(1)).alias("k")
    )
    shifts = slices.select(
        "_c",
        "_s",
        *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)],
        F.sum("k").over(W.partitionBy("_c")).alias("n"),
    )
    running = terms.select(
        "_c", "_s", "conv_id", "pos", *[F.bit_xor(f"t{i}").over(inside).alias(f"r{i}") for i in (1, 2)]
    )
    return running.join(shifts, ["_c", "_s"]).select(
        "conv_id",
        "pos",
        "n",
        *[F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)],
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n and copies of the conversations that no longer one continues.

    Equal conversations collapse to the smallest id first, so both sides of the
    anti-join hold every hash once and a first turn that a third of all
    conversations share is one row.
    """
    whole = hashes.where(F.col("pos") == F.col("n") - 1)
    own = ["n", "h1", "h2"]
    finals = whole.groupBy(*own).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = hashes.where(F.col("pos") < F.col("n") - 1)
    prefixes = inner.select((F.col("pos") + 1).alias("n"), "h1", "h2").distinct()
    return finals.join(prefixes, own, "left_anti").select("conv_id", "n", "copies")


def render(role: Column, text: Column) -> Column:
    """One turn in ChatML; markers inside a text are broken up by a backslash."""
    safe = F.replace(F.replace(text, F.lit(OPEN), F.lit("<\\|im_start|>")), F.lit(CLOSE), F.lit("<\\|im_end|>"))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(CLOSE), F.lit("\n"))


def format_chats(chats: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Render the maximal conversations in parts of up to ``part_turns`` turns.

    Columns: conv_id, part (from 0), n_turns (of the conversation), copies (equal
    conversations it stands for) and rendered. The parts of a conversation in order
    are its whole text; most have one. All rows without conv_id are one
    conversation. Extra columns are ignored and an empty table gives no rows.
    """
    rows = turns(chats)
    kept = maximal(prefix_hashes(rows)).withColumn("_c", F.coalesce("conv_id", F.lit(-(2**62))))
    keyed = rows.select(F.coalesce("conv_id", F.lit(-(2**62))).alias("_c"), "turn", "said", "role", "text")
    chosen = keyed.join(kept, "_c")
    placed = dense_index(chosen, ["_c"], ["turn", "said"], SLICE, "pos")
    line = F.struct("pos", render(F.col("role"), F.col("text")).alias("line"))
    parts = placed.groupBy("_c", F.expr(f"cast(pos div {int(part_turns)} as bigint)").alias("part")).agg(
        F.any_value("conv_id").alias("conv_id"),
        F.any_value("n").alias("n_turns"),
        F.any_value("copies").alias("copies"),
        F.array_sort(F.collect_list(line)).alias("lines"),
    )
    return parts.select(
        "conv_id", "part", "n_turns", "copies", F.array_join("lines.line", "").alias("rendered")
    )


SQL = """
with said as (
  select conv_id, coalesce(turn, -4611686018427387904) as turn,
         coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         md5(coalesce(role, 'unknown') || chr(10) || coalesce(text, '')) as said
  from conversations),
placed as (
  select *, row_number() over (partition by conv_id order by turn, said) - 1 as pos from said),
prefixes as (
  select conv_id, pos, count(*) over (partition by conv_id) as n,
         string_agg(said, ',') over (partition by conv_id order by pos rows unbounded preceding) as sofar
  from placed),
finals as (
  select sofar, n, min(conv_id) as conv_id, count(*) as copies
  from prefixes where pos = n - 1 group by sofar, n),
kept as (
  select conv_id, n, copies from finals f
  where not exists (select 1 from prefixes p where p.sofar = f.sofar and p.pos < p.n - 1))
select p.conv_id, cast(p.pos // {part} as bigint) as part, k.n as n_turns, k.copies,
       string_agg('<|im_start|>' || p.role || chr(10)
         || replace(replace(p.text, '<|im_start|>', '<\\|im_start|>'), '<|im_end|>', '<\\|im_end|>')
         || '<|im_end|>' || chr(10), '' order by p.pos) as rendered
from placed p join kept k on p.conv_id is not distinct from k.conv_id
group by p.conv_id, p.pos // {part}, k.n, k.copies
""".format(part=PART_TURNS)
