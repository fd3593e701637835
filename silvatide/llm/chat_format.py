"""Chat formatting: conversations as windows of a token budget, with a loss mask.

A turn is written as `### role: text </turn>` and a line feed. Inside roles and texts a backslash stands before each backslash, before each `#` that
follows another and before the slash of `</turn>`, in roles before colons too; so neither `##` nor `</turn>` occurs in them,
and taking the backslashes away gives the text back.

Prefix sums of the turns' tokens choose the windows: each takes as many new turns as its budget leaves, whole turns only.
Before them it has the conversation's system turn, and as many of the last turns as HISTORY tokens hold. The loss mask
covers the texts of new assistant turns; those that a window repeats are masked. A turn that does not fit with history stands without it, and one
that is longer than the budget stands alone behind the system turn, whole.

A conversation may hold any share of all rows: its turns are numbered by ranges, then it is cut into blocks of BLOCK turns
that are windowed on their own, each with the system turn and the last turns of the block before (a window ends where a block ends). Only the digest of a
conversation, which the operator does not need, reads all of its windows in order, one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import arrow_map, only, swept, table, written
from .token_output import encoder, tokenizer_path

BUDGET = 1024
HISTORY = 256
BLOCK = 512
#: Turns of the block before that a block may repeat: a turn has 5 tokens of markup at least, so HISTORY tokens hold no more.
TAIL = 64
SYSTEM, TARGET = "system", "assistant"

_IN_TEXT = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)")
_IN_ROLE = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
END = " </turn>\n"

# The conversation that the query adds, with control strings in its texts.
OWN_CONVERSATION = (-7, r"\### Assistant: </turn> ok")


def escaped(text: str) -> str:
    return _IN_TEXT.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head(role: str) -> str:
    return f"### {_IN_ROLE.sub(r'\\\g<0>', role)}: "


def formatted(role: str, text: str) -> str:
    return head(role) + escaped(text) + END


def parsed(text: str) -> list[tuple[str, str]]:
    """The role and text of each turn of a formatted text; anything else in it is an error."""
    *turns, rest = text.split(END)
    heads = [_HEAD.match(t) for t in turns]
    if rest or None in heads:
        raise ValueError("not a text of whole turns")
    return [(unescaped(m[1]), unescaped(t[m.end() :])) for m, t in zip(heads, turns, strict=True)]


def numbered(turns: DataFrame, tokenizer: str, block: int) -> DataFrame:
    """conv_id, pos, total, role, text, tokens of each turn: pos counts the conversation's turns from 0. Order: turn, role, then the text's sha256;
    nulls first. Null roles and texts are empty."""
    spark = turns.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            roles, texts = ([x or "" for x in b.column(n).to_pylist()] for n in ("role", "text"))
            _, n = enc.encode([formatted(r, t) for r, t in zip(roles, texts, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["conv_id", "turn", "role", "text", "tokens"])

    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    counted = arrow_map(plain, run, "conv_id bigint, turn bigint, role string, text string, tokens bigint")
    slim = written(spark, counted.withColumns({"tie": F.sha2("text", 256), "n": F.monotonically_increasing_id()}), "turns")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tie", "n"]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "tokens", F.monotonically_increasing_id().alias("at"))
    ordered = written(spark, ordered, "ordered").withColumn("part", F.shiftright("at", 33))
    # A row for each conversation and range; then places inside a range.
    each = ordered.groupBy("conv_id", "part").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("conv_id").orderBy("part")
    each = each.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), (F.sum("c").over(whole) - F.col("c")).alias("ahead"), F.sum("c").over(Window.partitionBy("conv_id")).alias("total"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at")) - 1
    placed = ordered.withColumn("inside", inside).join(each, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    return placed.select("conv_id", (F.col("ahead") + F.col("inside")).alias("pos"), "total", "role", "text", "tokens")


def _chosen(tokens: np.ndarray, start: int, system: int | None, budget: int, history: int) -> list[tuple[bool, int, int, int]]:
    """Windows over a block's turns: whether the system turn is repeated, and the turns from:to that are repeated and then up to `end` that are new.

    tokens: of all turns at hand; those before `start` belong to the block before. system: index of the system turn, if any.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    first = 0 if system is None else system + 1  # history never holds the system turn
    out, s = [], start
    while s < len(tokens):
        again = system is not None and s > system
        base = int(tokens[system]) if again else 0
        least = max(int(np.searchsorted(sums, sums[s] - history)), min(first, s))
        for lo in (least, s):
            end = int(np.searchsorted(sums, sums[s] + budget - base - (sums[s] - sums[lo]), "right")) - 1
            if end > s:
                break
        end = max(end, s + 1)
        out.append((again, lo, s, end))
        s = end
    return out


WINDOW_SCHEMA = "conv_id bigint, first_turn bigint, n_new int, n_repeated int, tokens bigint, text string, loss_start array<int>, loss_end array<int>"


def windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """The windows of conversations (conv_id, turn, role, text, whatever other columns there are), written under the shared folder and read back:
    conv_id, first_turn (the place of its first new turn), n_new, n_repeated, tokens, text, and the loss mask as ranges of code points.

    tokenizer: path of a tokenizer file on every worker. Null texts and roles are empty; null ids are one conversation; turns of one number go by
    role, then text's sha256; repeated rows are turns of their own; an empty table gives no window.
    """
    if not 0 <= history < budget or history > 5 * TAIL or block <= TAIL:
        raise ValueError(f"history must be below the budget and at most {5 * TAIL} tokens, a block longer than {TAIL} turns")
    spark = turns.sparkSession
    t = numbered(only(turns, "conv_id", "turn", "role", "text"), tokenizer, block)
    own = F.floor(F.col("pos") / block).cast("long")
    blocks = F.ceil(F.col("total") / block).cast("long")
    none = F.array().cast("array<bigint>")
    to_next = F.when((F.col("pos") % block >= block - TAIL) & (own + 1 < blocks), F.array(own + 1)).otherwise(none)
    to_all = F.when((F.col("pos") == 0) & (F.col("role") == SYSTEM) & (blocks > 1), F.sequence(F.lit(1), blocks - 1)).otherwise(none)
    dealt = t.withColumn("block", F.explode(F.concat(F.array(own), to_next, to_all))).select("conv_id", "block", "pos", "role", "text", "tokens")
    dealt = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def closed() -> pa.RecordBatch:
            (conv, number), rows = key, held
            system = 0 if rows[0][0] == 0 and rows[0][1] == SYSTEM else None
            start = next(k for k, r in enumerate(rows) if r[0] >= number * block)
            tokens = np.array([r[3] for r in rows], np.int64)
            out = []
            for again, lo, s, end in _chosen(tokens, start, system, budget, history):
                shown = ([system] if again else []) + list(range(lo, end))
                text, begins, ends, size, repeated = [], [], [], 0, len(shown) - (end - s)
                for k, i in enumerate(shown):
                    role, words = rows[i][1], escaped(rows[i][2])
                    a = size + len(head(role))
                    if role == TARGET and k >= repeated:
                        begins.append(a)
                        ends.append(a + len(words))
                    text.append(head(role) + words + END)
                    size = a + len(words) + len(END)
                out.append((conv, rows[s][0], end - s, repeated, int(tokens[shown].sum()), "".join(text), begins, ends))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            names = ["conv_id", "first_turn", "n_new", "n_repeated", "tokens", "text", "loss_start", "loss_end"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for conv, number, *row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if held and (conv, number) != key:
                    yield closed()
                    held = []
                key = (conv, number)
                held.append(row)
        if held:
            yield closed()

    return written(spark, arrow_map(dealt, run, WINDOW_SCHEMA), "windows")


def read_turns(made: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, under_loss of each turn, read back from the windows: of a window its new turns alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                spans = {r["text"][a:e] for a, e in zip(r["loss_start"], r["loss_end"], strict=True)}
                for k, (role, text) in enumerate(parsed(r["text"])[r["n_repeated"] :]):
                    out.append((r["conv_id"], r["first_turn"] + k, role, text, role == TARGET and escaped(text) in spans))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "pos", "role", "text", "under_loss"])

    return arrow_map(made, run, "conv_id bigint, pos bigint, role string, text string, under_loss boolean")


def digests(made: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows, a conversation's one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        key, turns, loss, n, chars, size, begun = None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
        for b in batches:
            out = []
            for conv, repeated, text, starts, ends in zip(*(b.column(k).to_pylist() for k in range(2, 7)), strict=True):
                if begun and conv != key:
                    out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                key, begun = conv, True
                for role, words in parsed(text)[repeated:]:
                    turns.update(f"{role}\n{words}\n".encode())
                    n += 1
                for a, e in zip(starts, ends, strict=True):
                    words = unescaped(text[a:e])
                    loss.update(words.encode())
                    chars += len(words)
                size += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((key, n, turns.hexdigest(), chars, loss.hexdigest(), size), kinds, strict=True)], names=names)

    # The first two columns name the order; the rest is what is read.
    one = made.select("first_turn", F.lit(0).alias("unused"), "conv_id", "n_repeated", "text", "loss_start", "loss_end")
    ordered = one.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return arrow_map(ordered, run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_own_conversation(turns: DataFrame) -> DataFrame:
    conv, text = OWN_CONVERSATION
    own = turns.sparkSession.createDataFrame([(conv, 0, "user", text), (conv, 1, TARGET, text)], "conv_id bigint, turn bigint, role string, text string")
    return only(turns, "conv_id", "turn", "role", "text").unionByName(own)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of conversations and the added conversation; what windows says of nulls, ties, repeated rows, long texts and empty tables holds."""
    with swept(spark) as kept:
        made = windows(with_own_conversation(table(spark, sf_dir, "conversations")), tokenizer_path())
        out = written(spark, digests(made), "chats")
        kept.append(out)
    return out
