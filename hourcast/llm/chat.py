"""Chat formatting by a finite-state machine over roles (operator 2).

A declarative template gives each role its name in the text, whether its
text counts for the loss, and which roles may come before it. The machine
walks a conversation's turns in order, marks turns out of order, and emits
text segments with a loss flag each: header, text, terminator. Control
strings inside texts are escaped and can be read back exactly.

Rows are dealt by conversation and sorted; the machine's state is the last
role, so a conversation of any length streams through in constant memory.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourcast.llm import common


@dataclass(frozen=True)
class Template:
    """roles: role -> (shown name, counts for the loss); after: state -> roles
    that may follow it; final: states a whole conversation may end in."""

    opener: str = "### "
    separator: str = ": "
    closer: str = "</turn>"
    newline: str = "\n"
    roles: dict = field(default_factory=lambda: {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)})
    after: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)

    def control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ("\\", self.opener, self.closer))))

    def escape(self, text: str) -> str:
        return self.control().sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(" + self.control().pattern + ")", r"\1", text)

    def header(self, role: str | None) -> str:
        """Declared roles show their name; others '?' and the escaped role, a
        null role '!'."""
        if role in self.roles:
            name = self.roles[role][0]
        elif role is None:
            name = "!"
        else:
            name = "?" + self.escape(role).replace(":", "\\:")
        return self.opener + name + self.separator

    def role_of(self, header: str) -> str | None:
        name = header[len(self.opener):-len(self.separator)]
        if name == "!":
            return None
        if name.startswith("?"):
            return self.unescape(name[1:].replace("\\:", ":"))
        return next(r for r, (shown, _) in self.roles.items() if shown == name)

    def format(self, role: str | None, text: str) -> list[tuple[str, bool]]:
        loss = role in self.roles and self.roles[role][1]
        return [(self.header(role), False), (self.escape(text), loss), (self.closer + self.newline, False)]

    def parse(self, out: str) -> list[tuple[str | None, str]]:
        """Turns of a formatted conversation."""
        any_text = r"(?:[^\\]|\\.)*?"
        turn = re.compile(re.escape(self.opener) + f"({any_text})" + re.escape(self.separator) + f"({any_text})"
                          + re.escape(self.closer + self.newline), re.S)
        turns, at = [], 0
        while at < len(out):
            m = turn.match(out, at)
            if not m:
                raise ValueError(f"not a formatted conversation at {at}")
            turns.append((self.role_of(self.opener + m[1] + self.separator), self.unescape(m[2])))
            at = m.end()
        return turns

    def step(self, state: str, role: str | None) -> tuple[str, bool]:
        """(next state, whether the turn is in order). A turn out of order
        moves the machine to its role all the same; unknown roles leave it."""
        ok = role in self.after.get(state, ())
        return (role if role in self.roles else state), ok


SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])


def format_conversations(rows: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, state, in_order, segments) per turn, in order within
    each conversation.

    Null text is empty. Rows with the same turn number are ordered by role,
    then text (nulls first); repeated rows are kept as turns. A null
    conversation id is a conversation of its own. Other columns are not read.
    """
    common.ship(rows.sparkSession)
    t = template or Template()
    src = rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), rows[role].cast("string").alias("role"),
                      F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"))
    dealt = src.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kinds = [src.schema[c].dataType.simpleString() for c in ("conv", "turn")]

    def run(batches):
        from hourcast.llm import chat
        state, now, begun = "start", None, False
        for b in batches:
            states, orders, segs = [], [], []
            for c, r, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if not begun or c != now:
                    state, now, begun = "start", c, True
                state, ok = t.step(state, r)
                states.append(state)
                orders.append(ok)
                segs.append([{"text": s, "loss": k} for s, k in t.format(r, x)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(states, pa.string()), pa.array(orders, pa.bool_()),
                                              pa.array(segs, pa.list_(chat.SEGMENT))],
                                             names=["conv", "turn", "role", "state", "in_order", "segments"])

    out = dealt.mapInArrow(run, f"conv {kinds[0]}, turn {kinds[1]}, role string, state string, in_order boolean, "
                                "segments array<struct<text:string,loss:boolean>>")
    for a, b in (("conv", conv), ("turn", turn), ("role", role)):
        out = out.withColumnRenamed(a, b)
    return out


def digest(formatted: DataFrame, template: Template | None = None, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the segments: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_out_of_order, complete.

    Takes the frame that ``format_conversations`` returns: its rows lie
    together by conversation and in order, so running hashes suffice.
    """
    t = template or Template()
    src = formatted.select(formatted[conv].alias("conv"), "segments", "state", "in_order")
    kind = src.schema["conv"].dataType.simpleString()
    fields = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
              "n_out_of_order long, complete boolean")

    def run(batches):
        import pyarrow as pa
        at = None
        for b in batches:
            done = []
            for c, segs, state, ok in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if at is None or at["conv"] != c:
                    if at:
                        done.append(at)
                    at = {"conv": c, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(),
                          "formatted_chars": 0, "n_out_of_order": 0, "state": "start"}
                whole = "".join(s["text"] for s in segs)
                for role, text in t.parse(whole):
                    at["n_turns"] += 1
                    at["turns"].update(f"{role or ''}\n{text}\n".encode())
                for s in segs:
                    if s["loss"]:
                        text = t.unescape(s["text"])
                        at["loss_chars"] += len(text)
                        at["loss"].update(text.encode())
                at["formatted_chars"] += len(whole)
                at["n_out_of_order"] += not ok
                at["state"] = state
            yield from out(done)
        if at:
            yield from out([at])

    def out(done):
        import pyarrow as pa
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d["conv"] for d in done], pa_kind), pa.array([d["n_turns"] for d in done], pa.int64()),
                 pa.array([d["turns"].hexdigest() for d in done]), pa.array([d["loss_chars"] for d in done], pa.int64()),
                 pa.array([d["loss"].hexdigest() for d in done]), pa.array([d["formatted_chars"] for d in done], pa.int64()),
                 pa.array([d["n_out_of_order"] for d in done], pa.int64()), pa.array([d["state"] in t.final for d in done], pa.bool_())],
                names=["conv", *[f.split()[0] for f in fields.split(", ")]])

    from pyspark.sql.pandas.types import to_arrow_type
    pa_kind = to_arrow_type(src.schema["conv"].dataType)
    return src.mapInArrow(run, f"conv {kind}, {fields}").withColumnRenamed("conv", conv)
