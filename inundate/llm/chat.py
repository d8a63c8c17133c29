"""Chat formatting by grammar round trip.

A turn is rendered as ``### role``, a line end, the body, a line end, ``</turn>``
and a line end.  ``### `` and ``</turn>`` are control strings.  A deterministic
parser reads the rendering back; where the turn it recovers differs from the
source, the body's control strings each get one more backslash before them, and
the turn is rendered and parsed again, until both are identical.

Rows: one per turn, ordered by (turn, role, text) within its conversation; the
concatenated segments of a conversation are its formatted text.  A null text or
role is empty; a null conv_id is a conversation of its own; repeated rows are
repeated turns; an empty table gives an empty table.  Turns stream through a
task in sorted order, so a conversation of any length needs bounded memory.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

OPEN, CLOSE = "### ", "</turn>"
CONTROL = re.compile(r"(\\*)(### |</turn>)")
STUFFED = re.compile(r"\\(\\*(?:### |</turn>))")
LEARNED = "assistant"


def escape(body: str) -> str:
    return CONTROL.sub(r"\\\1\2", body)


def unescape(body: str) -> str:
    return STUFFED.sub(r"\1", body)


def render(role: str, body: str) -> str:
    named = role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"{OPEN}{named}\n{body}\n{CLOSE}\n"


def _name(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line)


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the escaped body) of each turn; None if ``text`` breaks the grammar."""
    turns, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        if not text.startswith(OPEN, at) or line < 0:
            return None
        for m in CONTROL.finditer(text, line + 1):
            if not m[1]:
                break
        else:
            return None
        end = m.start() - 1
        if m[2] != CLOSE or end <= line or text[end] != "\n" or text[m.end() : m.end() + 1] != "\n":
            return None
        turns.append((_name(text[at + len(OPEN) : line]), unescape(text[line + 1 : end]), line + 1, end))
        at = m.end() + 1
    return turns


def round_trip(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a turn that parses back to exactly this turn, and its body's place."""
    body = text
    for _ in range(3):
        segment = render(role, body)
        found = parse(segment)
        if found is not None and len(found) == 1 and found[0][:2] == (role, text):
            return segment, found[0][2], found[0][3]
        body = escape(text)
    raise ValueError("a turn does not survive the round trip")


SEGMENT = "conv_id long, position long, segment string, loss_start long, loss_end long"
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _segments(it):
    conv, position, begun = None, 0, False
    for b in it:
        ids, segments, places, starts, ends = [], [], [], [], []
        for c, role, text in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
            if not begun or c != conv:
                conv, position, begun = c, 0, True
            segment, start, end = round_trip(role, text)
            learned = role == LEARNED
            ids.append(c)
            places.append(position)
            segments.append(segment)
            starts.append(start if learned else None)
            ends.append(end if learned else None)
            position += 1
        yield batch(_SEGMENT, conv_id=ids, position=places, segment=segments, loss_start=starts, loss_end=ends)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, position, segment and the loss mask (code points of the segment, end
    exclusive; null for turns that are not learned), one row per turn, each
    conversation together and in order."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_segments, SEGMENT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(it):
    conv, begun = None, False
    turns = chars = loss = 0
    said, learned = hashlib.sha256(), hashlib.sha256()
    out: list[tuple] = []
    for b in it:
        for c, segment, start, end in zip(*(b[n].to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
            if not begun or c != conv:
                if begun:
                    out.append((conv, turns, said.hexdigest(), loss, learned.hexdigest(), chars))
                conv, begun, turns, chars, loss = c, True, 0, 0, 0
                said, learned = hashlib.sha256(), hashlib.sha256()
            for role, text, _, _ in parse(segment):
                said.update(f"{role}\n{text}\n".encode())
                turns += 1
            chars += len(segment)
            if start is not None:
                masked = unescape(segment[start:end])
                loss += len(masked)
                learned.update(masked.encode())
        if len(out) >= 5000:
            yield batch(_DIGEST, **dict(zip(_DIGEST.names, zip(*out, strict=True), strict=True)))
            out = []
    if begun:
        out.append((conv, turns, said.hexdigest(), loss, learned.hexdigest(), chars))
    if out:
        yield batch(_DIGEST, **dict(zip(_DIGEST.names, zip(*out, strict=True), strict=True)))


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of the conversations, parsed from the segments as they stream by in order."""
    return segments.mapInArrow(_digests, DIGEST)
