"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose spans of whole turns. Each window holds the conversation's system turn, a
little history from before the span, and the span; only the span's assistant texts are targets, so that no
text is learnt twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, read

BUDGET = 1024         # tokens of a window
HISTORY_TURNS = 2     # turns repeated before a span, at most
HISTORY_SHARE = 4     # ... as long as they fit into BUDGET / HISTORY_SHARE tokens
BLOCK = 64            # turn numbers of one conversation that are summed in one group

# The template. Marks inside texts get a backslash after their first character (one more where they have some).
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = re.compile(r"([<\[])(\\*)(\|[a-z_]+\|>|/?s>|/?INST\]|<?/?SYS>>?)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\|[a-z_]+\|>|/?s>|/?INST\]|<?/?SYS>>?)")
PARSE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, loss spans in code points) of (role, text, is target) turns."""
    parts, spans, at = [], [], 0
    for role, text, target in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if target:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unescape(role), unescape(text)) for role, text in PARSE.findall(formatted)]


def word_tokens(text: Column) -> Column:
    """The default token count: words between spaces, and four for the marks of a turn."""
    return F.size(F.split(text, " ")) + 4


WINDOW_SCHEMA = "conv_id {}, conv_key string, window long, n_repeated int, n_tokens long, text string, " \
                "loss_spans array<struct<start:int,end:int>>"


def windows(turns: DataFrame, tokens=word_tokens, budget: int = BUDGET, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_id, conv_key, window, n_repeated, n_tokens, text, loss_spans.

    `turns` has conv_id, turn, role, text; other columns are not read. Turns are ordered by turn (null first),
    then role and a hash of the text; repeated rows are separate turns. Null roles and texts are empty; null
    conv_ids are one conversation. A first turn of role `system` is repeated in every window. A span takes
    the turns that lie between two multiples of the room that is left; a turn that crosses a multiple is a
    span of its own, so windows keep the budget unless a single turn exceeds the room, which stays whole.
    The first n_repeated turns of a window are repeats, outside the loss spans. No turns: no windows.

    Sums run inside (conversation, BLOCK turn numbers) and over one row per block, so that a long
    conversation is spread over tasks; a window's turns are bounded by the budget.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    key = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    rows = turns.select("conv_id", key.alias("conv_key"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).alias("block"), "turn",
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("n", tokens(F.col("text")).cast("long"))
    group = ["conv_key", "block"]
    before = Window.partitionBy("conv_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*group).agg(F.sum("n").alias("bn"), F.count("*").alias("bc")).select(
        *group, F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("bc"))
    inside = Window.partitionBy(*group).orderBy("turn", "role", F.xxhash64("text"))
    until = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("p", F.sum("n").over(until)).withColumn("i", F.row_number().over(inside)).join(blocks, group) \
        .select("conv_id", "conv_key", (F.col("bc") + F.col("i") - 1).alias("i"), (F.col("bn") + F.col("p") - F.col("n")).alias("start"),
                "n", "role", "text")
    placed = cut(placed)
    system = placed.where("i = 0 and role = 'system'").select("conv_key", F.col("n").alias("sn"), F.col("role").alias("srole"),
                                                              F.col("text").alias("stext"))
    # rows without texts: the span of each turn
    past = budget // HISTORY_SHARE
    room = F.greatest(F.lit(1), budget - past - F.coalesce("sn", F.lit(0)))
    stride = placed.select("conv_key", "i", "start", "n").join(system.select("conv_key", "sn"), "conv_key", "left")
    at, to = F.floor(F.col("start") / room), F.floor((F.col("start") + F.greatest(F.col("n"), F.lit(1)) - 1) / room)
    span = F.when((F.col("sn").isNotNull()) & (F.col("i") == 0), F.lit(-1).cast("long")).otherwise(at * 2 + (at != to).cast("long"))
    spans = stride.select("conv_key", "i", "start", "n", span.alias("span"))
    # an opening system turn goes with the first span after it
    spans = cut(spans)
    firsts = spans.where("span >= 0").groupBy("conv_key", "span").agg(F.min("i").alias("i0"), F.min("start").alias("s0"))
    lone = spans.where("span = -1").select("conv_key")
    order = Window.partitionBy("conv_key").orderBy("i0")
    head = firsts.join(lone.withColumn("sys", F.lit(True)), "conv_key", "left").withColumn("window", F.row_number().over(order) - 1)
    only_system = lone.join(firsts.select("conv_key").distinct(), "conv_key", "left_anti") \
        .select("conv_key", F.lit(-1).cast("long").alias("span"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("window"), F.lit(False).alias("again"))
    own = spans.where("span >= 0").select("conv_key", "i", "span").join(head.select("conv_key", "span", "window"), ["conv_key", "span"]) \
        .select("conv_key", "span", "i", "window", F.lit(False).alias("again"))
    opening = head.where("sys").select("conv_key", "span", F.lit(0).cast("long").alias("i"), "window", (F.col("window") > 0).alias("again"))
    prior = head.where(F.col("i0") > 0).select(
        "conv_key", "span", "window", "s0", F.col("sys").isNotNull().alias("sys"),
        F.explode(F.sequence(F.greatest(F.col("i0") - history_turns, F.lit(0)), F.col("i0") - 1)).alias("i")).where("not (sys and i = 0)")
    again = prior.join(spans.select("conv_key", "i", "start"), ["conv_key", "i"]).where(F.col("s0") - F.col("start") <= past) \
        .select("conv_key", "span", "i", "window", F.lit(True).alias("again"))
    members = own.unionByName(opening).unionByName(again).unionByName(only_system)
    full = members.join(placed, ["conv_key", "i"])
    grouped = full.groupBy("conv_key", "window").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("i", "again", "role", "text"))).alias("turns"))
    schema = WINDOW_SCHEMA.format(kind)
    return grouped.select("conv_id", "conv_key", "window", "n_tokens", "turns").mapInArrow(_format_all, schema)


def _format_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        texts, spans, repeated = [], [], []
        for turns in batch.column("turns").to_pylist():
            text, loss = format_turns([(t["role"], t["text"], t["role"] == "assistant" and not t["again"]) for t in turns])
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in loss])
            repeated.append(sum(t["again"] for t in turns))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("conv_key"), batch.column("window").cast(pa.int64()), pa.array(repeated, pa.int32()),
             batch.column("n_tokens"), pa.array(texts, pa.string()), pa.array(spans, spans_type)],
            ["conv_id", "conv_key", "window", "n_repeated", "n_tokens", "text", "loss_spans"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_windows, repeated_turns.

    A digest of a whole conversation is sequential. Windows are dealt by conversation, sorted, and streamed
    through the digests; a task holds one window at a time.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_key").sortWithinPartitions("conv_key", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows", "repeated_turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def row():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6], state[7])

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_key", "conv_id", "n_repeated", "text", "loss_spans")]
            for key, conv, skip, text, spans in zip(*columns):
                if key != current:
                    if state:
                        out.append(row())
                    current, state = key, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                turns = read_turns(text)
                again = 0
                for k, (role, body) in enumerate(turns):
                    if k < skip:
                        again += 1
                        continue
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    target = unescape(text[span["start"]:span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
                state[6] += 1
                state[7] += again
            if out:
                yield _rows(out, batch.schema.field("conv_id").type)
            kept_type = batch.schema.field("conv_id").type
        if state:
            yield _rows([row()], kept_type)

    def _rows(rows, conv_type):
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                   "formatted_chars long, n_windows long, repeated_turns long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(windows(turns.unionByName(added)))
