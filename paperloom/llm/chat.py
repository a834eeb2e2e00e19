r"""Chat formatting with a grammar round trip.

Rendered form of a turn: ``### Role: text``, a line feed, ``</turn>``, a line
feed. Headers and ``</turn>`` are control strings; inside texts each gets a
backslash in front, and so does a control string that already has backslashes,
which makes the escape reversible. A turn is first rendered as it is, reparsed
by the deterministic parser and compared with its source; where they differ,
its text is escaped and the turn is parsed again, until both are identical.

A conversation is one stream of turns: rows are sorted inside Spark and folded
one after the other, so a conversation of any length needs the memory of one
turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rendered name of each role; other roles are rendered as @ and their quoted name
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
LOSS_ROLE = "assistant"
END = "\n</turn>\n"
_NAMES = {v: k for k, v in ROLES.items()}
_HEADER = r"### (?:System|User|Assistant|@[^\s:]*): "
_HEAD = re.compile(_HEADER)
# looking behind keeps long runs of backslashes linear
_CONTROL = re.compile(rf"(?<!\\)(\\*)({_HEADER}|</turn>)")
_ESCAPED = re.compile(rf"(?<!\\)\\(\\*(?:{_HEADER}|</turn>))")
_ROUNDS = 8


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _render(role: str, text: str) -> tuple[str, str]:
    name = ROLES.get(role) or "@" + quote(role, safe="", errors="surrogatepass")
    return f"### {name}: ", text + END


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted conversation: role, text, and the span of the raw text.

    Raises ``ValueError`` where the grammar does not hold.
    """
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        if not head:
            raise ValueError(f"no header at {at}")
        begin = head.end()
        close = next((m for m in _CONTROL.finditer(formatted, begin) if not m[1]), None)
        if close is None or not formatted.startswith(END, close.start() - 1) or close.start() - 1 < begin:
            raise ValueError(f"turn at {at} is not closed")
        end = close.start() - 1
        name = head[0][4:-2]
        role = _NAMES.get(name)
        if role is None:
            role = unquote(name[1:], errors="surrogatepass")
        turns.append((role, unescape(formatted[begin:end]), begin, end))
        at = end + len(END)
    return turns


def format_turn(role: str, text: str) -> tuple[str, list[tuple[str, str, int, int]]]:
    """A rendered turn and what the parser reads from it: equal to the source."""
    content = text
    for _ in range(_ROUNDS):
        head, body = _render(role, content)
        try:
            turns = parse(head + body)
            if [(r, t) for r, t, _, _ in turns] == [(role, text)]:
                return head + body, turns
        except ValueError:
            pass
        content = escape(content)
    raise ValueError("a turn cannot be rendered reversibly")


def format_conversation(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and loss mask (spans of assistant texts) of whole conversations."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        part, parsed = format_turn(role or "", text or "")
        spans += [(at + b, at + e) for r, _, b, e in parsed if r == LOSS_ROLE]
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def _sorted_rows(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, position, formatted, loss_start, loss_end`` for every turn.

    Conversations are sorted by turn (ties: role, text; nulls first). A
    conversation's formatted text is its turns in order of ``position`` (code
    points before it); the loss span is null for turns without loss. Null roles
    and texts are empty; rows that repeat are turns of their own; a null conv_id
    is a conversation like others; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = _NOTHING, 0
        for batch in batches:
            out: dict[str, list] = {"position": [], "formatted": [], "loss_start": [], "loss_end": []}
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != current or current is _NOTHING:
                    current, at = conv, 0
                part, [(read, _, begin, end)] = format_turn(role or "", text or "")
                loss = read == LOSS_ROLE
                out["position"].append(at)
                out["formatted"].append(part)
                out["loss_start"].append(at + begin if loss else None)
                out["loss_end"].append(at + end if loss else None)
                at += len(part)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *arrays], ["conv_id", "turn", *out])

    return _sorted_rows(conversations).mapInArrow(
        run, "conv_id long, turn long, position long, formatted string, loss_start long, loss_end long"
    )


_NOTHING = object()


class _Reader:
    """Digests of one conversation, read back from its formatted turns."""

    def __init__(self) -> None:
        self.turns, self.loss, self.length = 0, 0, 0
        self.all_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str) -> None:
        for role, text, begin, end in parse(formatted):
            self.turns += 1
            self.all_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == LOSS_ROLE:
                masked = unescape(formatted[begin:end])
                self.loss += len(masked)
                self.loss_sha.update(masked.encode("utf-8", "surrogatepass"))
        self.length += len(formatted)

    def row(self, conv: int | None) -> dict:
        return {
            "conv_id": conv,
            "n_turns": self.turns,
            "turns_sha256": self.all_sha.hexdigest(),
            "loss_chars": self.loss,
            "loss_sha256": self.loss_sha.hexdigest(),
            "formatted_chars": self.length,
        }


_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def format_digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns by the parser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader = _NOTHING, _Reader()
        schema = pa.schema(
            [
                ("conv_id", pa.int64()),
                ("n_turns", pa.int64()),
                ("turns_sha256", pa.string()),
                ("loss_chars", pa.int64()),
                ("loss_sha256", pa.string()),
                ("formatted_chars", pa.int64()),
            ]
        )
        for batch in batches:
            rows = []
            for conv, part in zip(
                batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True
            ):
                if current is _NOTHING or conv != current:
                    if current is not _NOTHING:
                        rows.append(reader.row(current))
                    current, reader = conv, _Reader()
                reader.read(part)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if current is not _NOTHING:
            yield pa.RecordBatch.from_pylist([reader.row(current)], schema=schema)

    # sorted and co-located by conversation already: no further shuffle
    return formatted_turns(conversations).mapInArrow(run, _DIGESTS)
