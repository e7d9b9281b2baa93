"""Chat conversations as marked text with loss flags, and the way back.

A declarative template gives each role a header, one turn end for all roles, and the roles
whose text is trained on. A finite-state machine over roles says which turn may follow which.
Control strings inside texts are broken up by an escape sign and restored on reading.

Turns are dealt by conversation and sorted, and each task walks through its rows once with
the state of the current conversation only, so a conversation of any length needs no more
memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    headers: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ",
    })
    #: Header of a role that has none; the escaped role and a turn end follow it.
    other: str = "### Role: "
    end: str = "</turn>"
    after: str = "\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: Allowed roles by state; a role's name is the state after it.
    follow: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "": frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"}),
    })
    final: frozenset[str] = frozenset({"assistant"})

    def control(self) -> list[str]:
        return sorted({*(h.rstrip() for h in self.headers.values()), self.other.rstrip(), self.end}, key=len, reverse=True)


class Codec:
    """Escaping, formatting and reading by one template."""

    def __init__(self, template: Template) -> None:
        self.template = template
        marks = "|".join(re.escape(c) for c in template.control())
        self._risky = re.compile(f"{re.escape(ESCAPE)}|{marks}")
        self._escaped = re.compile(f"{re.escape(ESCAPE)}(.)", re.DOTALL)
        self._roles = {h: r for r, h in template.headers.items()}
        heads = "|".join(re.escape(h) for h in sorted([*self._roles, template.other], key=len, reverse=True))
        unit = f"(?:[^{re.escape(ESCAPE)}]|{re.escape(ESCAPE)}.)*?"
        end, other = re.escape(template.end), re.escape(template.other)
        self._turn = re.compile(
            f"(?P<head>{heads})(?:(?<={other})(?P<role>{unit}){end})?(?P<text>{unit}){end}{re.escape(template.after)}", re.DOTALL
        )

    def escape(self, text: str) -> str:
        return self._risky.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The (text, under loss) parts of a turn, in order."""
        t = self.template
        head = t.headers.get(role, f"{t.other}{self.escape(role)}{t.end}")
        return [(head, False), (self.escape(text), role in t.loss_roles), (t.end + t.after, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of formatted text."""
        turns, at = [], 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at character {at}")
            role = self._roles[m["head"]] if m["head"] in self._roles else self.unescape(m["role"])
            turns.append((role, self.unescape(m["text"])))
            at = m.end()
        return turns


_SEGMENTS = "conv_id long, position long, segments array<struct<text: string, loss: boolean>>, follows boolean, last boolean, accepted boolean"
_PARTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn of ``turns(conv_id, turn, role, text)``, in order within each task.

    ``segments`` concatenate to the turn's text, ``follows`` says whether the state machine
    allows the role here, ``last`` marks a conversation's last turn, and ``accepted`` on it
    says whether all turns were allowed and the state was final. Conversations are kept whole
    whether accepted or not; filter on ``accepted`` to drop them.

    Null texts and roles count as empty, rows without conv_id are one conversation of their
    own, null turns come first, repeated rows are repeated turns, ties in ``turn`` are ordered
    by role and text, other columns are ignored, an empty table gives no rows.
    """
    codec = Codec(template or Template())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = codec.template
        held: list | None = None
        state, clean, position = "", True, 0
        out: list[list] = []

        def close() -> None:
            held[4], held[5] = True, clean and state in rules.final
            out.append(held)

        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                role = role or ""
                if held is None or held[0] != conv:
                    if held is not None:
                        close()
                    state, clean, position = "", True, 0
                else:
                    out.append(held)
                follows = role in rules.follow.get(state, ())
                clean, state = clean and follows, role
                parts = [{"text": t, "loss": loss} for t, loss in codec.segments(role, text or "")]
                held = [conv, position, parts, follows, False, None]
                position += 1
            if out:
                yield _batch(out)
        out = []
        if held is not None:
            close()
            yield _batch(out)

    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), "role", "text"
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "role", "text"
    ).mapInArrow(run, _SEGMENTS)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), _PARTS, pa.bool_(), pa.bool_(), pa.bool_()]
    names = ["conv_id", "position", "segments", "follows", "last", "accepted"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def chat_digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Read the rows of ``format_chats`` back, as they lie in its tasks: one row of sums per conversation."""
    codec = Codec(template or Template())
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, accepted boolean"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, said, under, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        for batch in batches:
            out = []
            for conv, parts, last, accepted in zip(*(batch.column(k).to_pylist() for k in (0, 2, 4, 5))):
                whole = "".join(p["text"] for p in parts)
                for role, text in codec.read(whole):
                    said.update(f"{role}\n{text}\n".encode())
                    count += 1
                learnt = "".join(codec.unescape(p["text"]) for p in parts if p["loss"])
                under.update(learnt.encode())
                loss_chars += len(learnt)
                chars += len(whole)
                if last:
                    out.append((conv, count, said.hexdigest(), loss_chars, under.hexdigest(), chars, accepted))
                    count, said, under, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return formatted.mapInArrow(run, schema)
