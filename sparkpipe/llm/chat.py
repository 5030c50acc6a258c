"""Chat formatting with a grammar round trip (operator 6)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_rows

#: turn := OPEN role "\n" text END, where neither role nor text holds a MARK and the role no line break;
#: or OPEN_ESCAPED role "\n" text END, where every MARK, backslash and, in the role, line break is escaped.
MARK, OPEN, OPEN_ESCAPED, END = "<|", "<|turn|>", "<|turn:escaped|>", "<|end|>\n"
_SEGMENTS = "conv_id long, seq long, segment string, start long, loss_start long, loss_end long"


def escape(text: str) -> str:
    """Leaves no MARK, so no control string either; undone by unescape."""
    return text.replace("\\", "\\\\").replace(MARK, "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def render_turn(role: str, text: str, escaped: bool) -> tuple[str, int, int]:
    """A turn's segment and where its text lies in it."""
    head = OPEN_ESCAPED + escape(role).replace("\n", "\\n") + "\n" if escaped else f"{OPEN}{role}\n"
    body = escape(text) if escaped else text
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int, bool]] | None:
    """(role, text, start, end, escaped) for each turn of a formatted conversation; None if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        escaped = formatted.startswith(OPEN_ESCAPED, at)
        if not escaped and not formatted.startswith(OPEN, at):
            return None
        at += len(OPEN_ESCAPED if escaped else OPEN)
        line = formatted.find("\n", at)
        end = formatted.find(MARK, at)
        if line < 0 or end < line or not formatted.startswith(END, end):
            return None
        role, text = formatted[at:line], formatted[line + 1 : end]
        turns.append((unescape(role), unescape(text), line + 1, end, True) if escaped else (role, text, line + 1, end, False))
        at = end + len(END)
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The plain form if the parser gets the turn back from it, else the escaped one, which is held to the same test."""
    for escaped in (False, True):
        out = render_turn(role, text, escaped)
        back = parse(out[0])
        if back is not None and [t[:2] for t in back] == [(role, text)]:
            return out
    raise ValueError("a turn did not survive its round trip")


def format_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, seq, segment, start, loss_start, loss_end): a conversation's segments, joined by seq, are its format.

    start is the segment's place in the conversation in code points; loss_start and loss_end enclose the text of a
    loss_role's turn, else they are null.  Each segment is reparsed and escaped if need be; no segment can change how
    another is parsed, since each ends where the parser ends it.  A partition has its conversations one after another,
    segments in order, and a task holds one batch of turns, however long a conversation is.

    Null roles and texts count as empty; turns that share a number go by role and text, null numbers first; repeated
    rows are turns of their own; rows without an id form one conversation.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, at = object(), 0, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != now:
                    now, seq, at = conv, 0, 0
                segment, a, b = format_turn(role, text)
                loss = role == loss_role
                for column, v in zip(out, (conv, seq, segment, at, at + a if loss else None, at + b if loss else None), strict=True):
                    column.append(v)
                seq, at = seq + 1, at + len(segment)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["conv_id", "seq", "segment", "start", "loss_start", "loss_end"])

    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return arrow_rows(ordered, run, _SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the segments of format_turns in the order of seq: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.  The digests are sequential, so a conversation is one
    task's, segment by segment.  An empty table gives an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[]] * 6
            out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for conv, segment, start, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _, escaped in parse(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if a is not None:
                        masked = segment[a - start : b - start]
                        masked = unescape(masked) if escaped else masked
                        state[3] += len(masked)
                        state[4].update(masked.encode())
                state[5] += len(segment)
            yield batch_of()
        close()
        yield batch_of()

    ordered = segments.select("conv_id", "seq", "segment", "start", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return arrow_rows(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_format(role: str, text: str) -> str:
    """DuckDB SQL for the length of a turn's segment."""
    longer = lambda x: f"length(replace(replace({x}, '\\', '\\\\'), '{MARK}', '<\\|'))"
    role_breaks = f"length({role}) - length(replace({role}, chr(10), ''))"
    escaped = f"{longer(text)} + {longer(role)} + {role_breaks} + {len(OPEN_ESCAPED) + 1 + len(END)}"
    plain = f"length({text}) + length({role}) + {len(OPEN) + 1 + len(END)}"
    return f"CASE WHEN contains({text}, '{MARK}') OR contains({role}, '{MARK}') OR contains({role}, chr(10)) THEN {escaped} ELSE {plain} END"


#: DuckDB SQL for the digests over the table conversations and the added conversation -7.
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_sql_format("role", "text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
