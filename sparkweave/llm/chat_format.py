"""Chat formatting with typed content parts (operator 12).

A message is a role and an array of parts: struct<kind, text, ref, amount>. A visitor (Visitor, one method for each
kind) flattens the parts in order: a text is escaped, an image, a recording or a document becomes a placeholder, and
its reference and the number of tokens that it expands to are recorded. All of it is column expressions, made before
any shuffle.

A turn is written as <s>role[INST]content[/INST]</s>. Control strings inside roles and texts get a backslash after
their first character; a control string that has backslashes there already gets one more. Taking one away gives the
text back. No control string holds another's first character inside, so no two matches overlap.

Each row of the result is one turn: its place, text, begin in the conversation (in code points), the span under the
loss mask (the content of assistant turns, markers excluded), attachments and their tokens. A conversation is the
concatenation of its rows; it is never gathered into one, so its length is bounded by disk alone.

Edge cases: a null text or role is empty, a message whose parts are null or empty has no content. A part of an unknown
or null kind is a text. A null or negative amount counts as 0, and an attachment has one token at least. Rows without
a conv_id are one conversation. Ties of turn are ordered by role, then by content; a null turn comes last. Repeated
rows are turns each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import attach

PARTS = "array<struct<kind:string,text:string,ref:string,amount:double>>"

#: The template's control strings, all of which texts may hold only escaped.
BEGIN, SAYS, SAID, END = "<s>", "[INST]", "[/INST]", "</s>"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
CONTROL = (BEGIN, SAYS, SAID, END, *PLACEHOLDERS.values())

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE, UNESCAPE = rf"([<\[])(\\*)({_TAILS})", rf"([<\[])\\(\\*)({_TAILS})"
_TURN = re.compile(rf"{re.escape(BEGIN)}(.*?){re.escape(SAYS)}(.*?){re.escape(SAID)}{re.escape(END)}", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return re.sub(UNESCAPE, r"\1\2\3", text)


@dataclass
class Visitor:
    """What each kind of part becomes: struct<shown, kind, ref, tokens>; kind is null for texts.

    units: how much of a part's amount makes one token: pixels of an image, seconds of a recording, pages of a document.
    """

    units: dict[str, float] = field(default_factory=lambda: {"image": 784.0, "audio": 0.04, "document": 1 / 576})

    def text(self, part: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(escaped(F.coalesce(part["text"], F.lit(""))).alias("shown"), none.alias("kind"), none.alias("ref"), F.lit(0).cast("long").alias("tokens"))

    def attachment(self, kind: str, part: Column) -> Column:
        amount = F.greatest(F.coalesce(F.nanvl(part["amount"], F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
        tokens = F.greatest(F.ceil(amount / F.lit(self.units[kind])).cast("long"), F.lit(1).cast("long"))
        return F.struct(F.lit(PLACEHOLDERS[kind]).alias("shown"), F.lit(kind).alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))

    def image(self, part: Column) -> Column:
        return self.attachment("image", part)

    def audio(self, part: Column) -> Column:
        return self.attachment("audio", part)

    def document(self, part: Column) -> Column:
        return self.attachment("document", part)

    def visit(self, part: Column) -> Column:
        out = None
        for kind in PLACEHOLDERS:
            out = (F if out is None else out).when(part["kind"] == kind, getattr(self, kind)(part))
        return out.otherwise(self.text(part))


def text_parts(text: Column) -> Column:
    """A plain text as the only part of a message."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def format_chats(messages: DataFrame, visitor: Visitor | None = None, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, turn, role, parts. A row for each turn: conv_id, place, formatted, begin, loss_begin, loss_end, attachments, tokens.

    loss_begin and loss_end are null for roles that are not learned. attachments: struct<kind, ref, tokens> in the order
    of their placeholders. The rows of a conversation come together and in order.
    """
    visit = (visitor or Visitor()).visit
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    role = F.coalesce("role", F.lit(""))
    rows = messages.select("conv_id", "turn", role.alias("role"), F.transform(parts, visit).alias("visited"))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit(BEGIN), escaped(F.col("role")), F.lit(SAYS)).alias("head"),
        F.array_join(F.transform("visited", lambda p: p["shown"]), "").alias("content"),
        F.transform(F.filter("visited", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"),
    )
    rows = rows.withColumn("formatted", F.concat("head", "content", F.lit(SAID + END)))
    size = F.length("formatted").cast("long")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "content")
    so_far = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn("begin", so_far - size)
    is_learned, loss_begin = F.col("role").isin(*learned), F.col("begin") + F.length("head")
    return rows.select(
        "conv_id",
        "place",
        "formatted",
        "begin",
        F.when(is_learned, loss_begin).alias("loss_begin"),
        F.when(is_learned, loss_begin + F.length("content")).alias("loss_end"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
    )


def in_order(turns: DataFrame) -> DataFrame:
    """Turns that were stored, with each conversation's rows together and in order again."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn, unescaped; placeholders stay as they are."""
    found = _TURN.fullmatch(formatted)
    if found is None:
        raise ValueError(f"not a formatted turn: {formatted[:200]}")
    return unescaped(found[1]), unescaped(found[2])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from what format_chats (or in_order) returns.

    A task reads the turns of its conversations one after the other and holds one batch of them.
    """
    attach(turns.sparkSession)

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[list] = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*((c, n, all_turns.hexdigest(), chars, loss.hexdigest(), size) for c, n, all_turns, chars, loss, size in done), strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, place, formatted, begin, loss_begin, loss_end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "formatted", "begin", "loss_begin", "loss_end")), strict=True):
                if place == 0:
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    done.append(now)
                if now is None or now[0] != conv or now[1] != place or now[5] != begin:
                    raise ValueError(f"turns of conversation {conv} are not in order")
                role, text = read_turn(formatted)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[5] += len(formatted)
                if loss_begin is not None:
                    learned = unescaped(formatted[loss_begin - begin : loss_end - begin])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
            if len(done) > 10_000:
                last = done.pop()
                yield rows()
                done.append(last)
        if done:
            yield rows()

    columns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "place", "formatted", "begin", "loss_begin", "loss_end")
    return columns.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
