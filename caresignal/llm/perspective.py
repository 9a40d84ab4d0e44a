"""Chat formatting (operator 8): multi-party perspective rotation.

For every participant of a conversation, the dialogue is rendered with that speaker as
the assistant and everyone else as a named user; the mask holds the spans of the
assistant's own words. System turns give context: they are no participant and keep
their header in every perspective.

A dialogue is rendered in parts of PART_TURNS consecutive turn numbers, so a
conversation of any length is spread over many rows and tasks; a part with more turns
than PART_LIMIT (many rows with one turn number) is cut further, in order: sub k holds the
k-th stretch of PART_LIMIT turns. The full rendering of a perspective is its parts in
(part, sub) order. Participants are joined to
parts by conversation; the join's participant side has one row per speaker.

Defined cases: exact repeats of a turn (all four columns) count once; turns with one
number are ordered by role, then text; a null turn number comes first (part -1); a null
text is empty; a null or empty role is the speaker "unknown"; rows with a null
conversation id form one conversation of their own; a conversation with system turns
only has no perspective and no row. Control markers inside names and texts are broken
up with a space, so they cannot forge a turn.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, maybe_broadcast, shuffle_partitions

PART_TURNS, PART_LIMIT = 32, 64
#: The list of parts to cut is broadcast up to this many rows, joined by a shuffle beyond.
BROADCAST_PARTS = 100_000
SYSTEM_ROLES = ("system",)
UNKNOWN = "unknown"
#: Rendered turn: header, text, end marker. The end marker after the assistant's words is learned too.
HEADER_ASSISTANT, HEADER_USER, HEADER_SYSTEM, END = "<|assistant|>\n", "<|user name={}|>\n", "<|system|>\n", "<|end|>\n"


def _plain(s: str) -> str:
    return s.replace("<|", "< |")


def _name(s: str) -> str:
    return " ".join(_plain(s).replace("|>", "| >").split())


def render(turns: list[tuple[str, str]], assistant: str, system: tuple[str, ...] = SYSTEM_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """(text, mask spans in code points) of (role, text) turns."""
    out, spans, at = [], [], 0
    for role, said in turns:
        said = _plain(said)
        head = HEADER_SYSTEM if role in system else HEADER_ASSISTANT if role == assistant else HEADER_USER.format(_name(role))
        body = said + END
        if role == assistant and role not in system:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body]
        at += len(head) + len(body)
    return "".join(out), spans


def _stretches(t: DataFrame) -> DataFrame:
    """`t` (conv_id, part, turn, role, text; no row twice) with sub: the stretch of PART_LIMIT rows, in order, that a
    row of its part is in. Rows are sorted over all tasks, numbered within each, and a part's rows in earlier tasks added."""
    order = ["conv_id", "part", "turn", "role", "text"]
    t = t.repartitionByRange(shuffle_partitions(t.sparkSession), *order).sortWithinPartitions(*order)
    t = checkpointed(t.withColumn("pos", F.monotonically_increasing_id())).withColumn("task", F.shiftright("pos", 33))
    first = t.groupBy("conv_id", "part", "task").agg(F.min("pos").alias("lo"), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = first.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("task").alias("k"),
                         (F.coalesce(earlier, F.lit(0)) - F.col("lo")).alias("shift"))
    first = maybe_broadcast(checkpointed(first), BROADCAST_PARTS)
    j = t.join(first, t.conv_id.eqNullSafe(first.c) & (t.part == first.p) & (t.task == first.k))
    sub = F.floor((F.col("pos") + F.col("shift")) / PART_LIMIT).cast("int").alias("sub")
    return j.select("conv_id", "part", "turn", "role", "text", sub)


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           system: tuple[str, ...] = SYSTEM_ROLES) -> DataFrame:
    """One row per conversation, perspective (assistant) and part: conv_id, assistant, part, sub, n_turns, n_own,
    text, mask (array of start/end), mask_chars."""
    r = F.when(F.trim(F.col(f"`{role}`")) == "", None).otherwise(F.col(f"`{role}`"))
    t = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
                     F.coalesce(r, F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-1)).alias("part")
    t = t.select("conv_id", part, "turn", "role", "text")
    # parts that hold more rows (repeats included) than turn numbers can explain are cut in order; the rest have sub 0
    big = checkpointed(t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART_LIMIT)
                       .select(F.col("conv_id").alias("c"), F.col("part").alias("p")))
    if big.isEmpty():
        t = t.distinct().withColumn("sub", F.lit(0))
    else:
        big = maybe_broadcast(big, BROADCAST_PARTS)
        of_big = t.conv_id.eqNullSafe(big.c) & (t.part == big.p)
        rest = t.join(big, of_big, "left_anti").distinct().withColumn("sub", F.lit(0))
        t = rest.unionByName(_stretches(t.join(big, of_big, "left_semi").distinct()))
    parts = (t.groupBy("conv_id", "part", "sub")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))
    people = (t.filter(~F.col("role").isin(*system)).groupBy("conv_id", "role").agg(F.lit(1).alias("one"))
              .select(F.col("conv_id").alias("c"), F.col("role").alias("assistant")))
    j = parts.join(people, parts.conv_id.eqNullSafe(people.c)).select("conv_id", "assistant", "part", "sub", "turns")
    kind = turns.schema[conv_id].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        text, mask, n, own, chars = [], [], [], [], []
        for who, ts in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
            x, spans = render([(t["role"], t["text"]) for t in ts], who, system)
            text.append(x)
            mask.append([{"start": a, "end": e} for a, e in spans])
            n.append(len(ts))
            own.append(len(spans))
            chars.append(sum(e - a for a, e in spans))
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [*b.columns[:4], pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(text, pa.string()), pa.array(mask, spans_type), pa.array(chars, pa.int64())],
            names=["conv_id", "assistant", "part", "sub", "n_turns", "n_own", "text", "mask", "mask_chars"])
    return map_batches(j, run, f"conv_id {kind}, assistant string, part bigint, sub int, n_turns bigint, n_own bigint, text string, "
                               "mask array<struct<start:bigint,end:bigint>>, mask_chars bigint")
