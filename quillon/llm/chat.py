"""Chat formatting: a finite-state machine over roles, and a declarative template of segments with loss flags.

A conversation's rows are taken by turn, equal turns by role and text, null turns first. The machine goes through their roles and says of each turn
whether it may stand there; every turn is formatted, allowed or not, as three segments: head, text and tail, of which only the text may be under the loss mask.
Control strings inside texts and roles are escaped so that reading gives them back.

A conversation of very many turns is dealt out in stretches of turn numbers. Each stretch is first summed up as the state it ends in for every state it
may begin in; the sums of one conversation are chained, and then all stretches are formatted at the same time.

Null texts and roles are empty; an unknown role is formatted, and never allowed nor under the loss mask. Rows without a conversation's id are one
conversation; repeated rows are turns of their own. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import save

#: Turn numbers of a stretch.
STRETCH = 1024


@dataclass(frozen=True)
class Template:
    """``order`` gives the next state for a state and a role; ``resume`` the state after a role that may not stand where it does (else the state
    stays). A turn is ``begin role middle text end``. Every control string starts with ``<|``."""

    order: dict[str, dict[str, str]]
    resume: dict[str, str]
    start: str = "start"
    loss: tuple[str, ...] = ("assistant",)
    begin: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    states: list[str] = field(init=False)

    def __post_init__(self):
        found = {self.start, *self.order, *self.resume.values(), *(s for to in self.order.values() for s in to.values())}
        object.__setattr__(self, "states", sorted(found))

    def step(self, state: str, role: str) -> tuple[str, bool]:
        to = self.order.get(state, {}).get(role)
        return (self.resume.get(role, state), False) if to is None else (to, True)


#: An optional system turn, then users and assistants in turn; an assistant's call may be answered by a tool before it goes on.
CHAT = Template(
    order={"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"},
           "answered": {"user": "asked", "tool": "called"}, "called": {"assistant": "answered"}},
    resume={"system": "briefed", "user": "asked", "assistant": "answered", "tool": "called"})


def escaped(text: Column) -> Column:
    """A text that holds no ``<|``: one backslash more between ``<`` and ``|`` wherever only backslashes stand between them."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_in(role: Column) -> Column:
    """A role within a head: without line ends and control strings."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_out(role: Column) -> Column:
    split = F.split(unescaped(role), r"\\\\", -1)  # at pairs of backslashes, so that \n is a line end only where its backslash is single
    return F.array_join(F.transform(split, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return own.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(2**62))))


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", *order)


def _starts(turns: DataFrame, template: Template) -> DataFrame:
    """``(conv_id, stretch, state)`` of all stretches but the first, for conversations that have several."""
    ends = turns.groupBy("conv_id").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("low < high").select(F.col("conv_id").alias("_c"))
    rows = turns.select("conv_id", "stretch", "turn", "role").join(ends, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, to = None, None
        for batch in batches:
            out = []
            for *at, role in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if at != key:
                    if key:
                        out.append((*key, to))
                    key, to = at, template.states
                to = [template.step(s, role)[0] for s in to]
            yield _batch(out, summed)
        if key:
            yield _batch([(*key, to)], summed)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = (), None
        for batch in batches:
            out = []
            for conv, stretch, to in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) == last:
                    out.append((conv, stretch, state))
                else:
                    last, state = (conv,), template.start
                state = to[template.states.index(state)]
            yield _batch(out, started)

    summed = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("to", pa.list_(pa.string()))])
    started = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("state", pa.string())])
    sums = _in_order(rows, "turn", "role").mapInArrow(sums, "conv_id long, stretch long, to array<string>")
    return sums.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(chained, "conv_id long, stretch long, state string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def format_turns(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """``(conv_id, stretch, at, turn, allowed, segments)`` of ``(conv_id, turn, role, text)``: one row a turn, with ``segments`` an
    ``array<struct<text, loss>>``. A conversation's output is its segments in the order of ``stretch`` and ``at``."""
    turns = _turns(conversations)
    starts = save(_starts(turns, template), "chat-states").select(F.col("conv_id").alias("_c"), F.col("stretch").alias("_s"), "state")
    rows = turns.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("stretch") == F.col("_s")), "left").drop("_c", "_s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, place = None, None, 0
        for batch in batches:
            at, allowed = [], []
            for conv, stretch, role, begun in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "stretch", "role", "state"))):
                if (conv, stretch) != key:
                    key, state, place = (conv, stretch), begun or template.start, 0
                state, right = template.step(state, role)
                at.append(place)
                allowed.append(right)
                place += 1
            kept = [batch.column(name) for name in ("conv_id", "stretch", "turn", "role", "text")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int64()), pa.array(allowed, pa.bool_())], ["conv_id", "stretch", "turn", "role", "text", "at", "allowed"])

    out = _in_order(rows, "turn", "role", "text").mapInArrow(run, "conv_id long, stretch long, turn long, role string, text string, at long, allowed boolean")
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.array(piece(F.concat(F.lit(template.begin), _role_in(F.col("role")), F.lit(template.middle)), F.lit(False)),
                       piece(escaped(F.col("text")), F.col("role").isin(*template.loss)), piece(F.lit(template.end), F.lit(False)))
    return out.select("conv_id", "stretch", "at", "turn", "allowed", segments.alias("segments"))


def read_turns(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """``(conv_id, stretch, at, allowed, role, text, loss_text, n_chars)`` read from the segments: role and text from their plain concatenation, ``loss_text`` from
    those under the mask."""
    whole = F.array_join(F.transform("segments", lambda x: x["text"]), "")
    rows = formatted.select("conv_id", "stretch", "at", "allowed", whole.alias("_whole"), F.filter("segments", lambda x: x["loss"]).alias("_loss"))
    body = F.substr("_whole", F.lit(len(template.begin) + 1))
    cut = F.locate(template.middle, F.col("_body"))
    rows = rows.withColumn("_body", body).withColumn("_cut", cut)
    text = F.substring_index(F.expr("substring(_body, _cut + %d)" % len(template.middle)), template.end, 1)
    return rows.select("conv_id", "stretch", "at", "allowed", _role_out(F.expr("substring(_body, 1, _cut - 1)")).alias("role"), unescaped(text).alias("text"),
                       F.array_join(F.transform("_loss", lambda x: unescaped(x["text"])), "").alias("loss_text"), F.length("_whole").cast("long").alias("n_chars"))


def digests(turns: DataFrame) -> DataFrame:
    """One row a conversation of ``read_turns``: number of turns, digests of its turns and of its text under the loss mask, sizes, and whether the machine allows all
    turns. A digest goes through a conversation's rows in order, and holds none of them."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                        ("formatted_chars", pa.int64()), ("allowed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = (), None
        done = lambda: (key[0], now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], now[5])
        for batch in batches:
            out = []
            for conv, allowed, role, text, loss, n in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "allowed", "role", "text", "loss_text", "n_chars"))):
                if (conv,) != key:
                    if key:
                        out.append(done())
                    key, now = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                now[0] += 1
                now[1].update(f"{role}\n{text}\n".encode())
                now[2] += len(loss)
                now[3].update(loss.encode())
                now[4] += n
                now[5] &= allowed
            yield _batch(out, schema)
        if key:
            yield _batch([done()], schema)

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "at")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, allowed boolean")
