"""Chat formatting by a grammar round trip.

The template, in grammar form (text is escaped content):

    conversation = { turn }
    turn         = "<s>[INST] " text " [/INST]"            a user turn
                 | " " text " </s>"                        an assistant turn
                 | "<<SYS>> " text " <</SYS>>"             a system turn
                 | "<<ROLE>> " role " <<//>> " text " <</ROLE>>"  a turn of any other role

A deterministic parser reads it back from left to right. A backslash before a control string, or before another backslash,
makes what follows plain text. A turn is rendered with its text as it is and parsed again; if that does not give the turn,
more is escaped (first control strings, then backslashes too) until it does.

Turns are rendered, and checked on their own, in any task. Conversations are then put together from rows sorted inside the
partition: the same parser reads the joined text as it grows, without being told where a turn ends, and has to find the
turns that were rendered, in their order, and nothing left over. Memory holds one turn and one batch, so a conversation
may be of any length. The results are one row for each turn, with its place in the conversation's text and the span under
the loss mask, as a trainer needs them, or one row with digests for each conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .shingles import slices

#: The control strings. None holds another or overlaps one.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<//>>", "<</ROLE>>")
_ANY = re.compile("|".join(map(re.escape, CONTROL)))
_TOKEN = re.compile(rf"\\(\\|{_ANY.pattern})|{_ANY.pattern}")
_CONFLICT = (re.compile("(?!)"), _ANY, re.compile(rf"\\|{_ANY.pattern}"))


def escape(text: str, level: int) -> str:
    """Level 0 leaves the text, 1 puts a backslash before control strings, 2 before backslashes too."""
    return _CONFLICT[level].sub(lambda m: "\\" + m.group(), text)


def render(role: str, text: str, level: int) -> str:
    t = escape(text, level)
    if role == "user":
        return f"<s>[INST] {t} [/INST]"
    if role == "assistant":
        return f" {t} </s>"
    if role == "system":
        return f"<<SYS>> {t} <</SYS>>"
    return f"<<ROLE>> {escape(role, level)} <<//>> {t} <</ROLE>>"


def unescape(text: str) -> str:
    return _TOKEN.sub(lambda m: m.group(1) or m.group(), text)


class Malformed(ValueError):
    """A text that the grammar does not have."""


def _content(s: str, at: int, end: str) -> tuple[str, int] | None:
    """Plain text up to a space and the control string `end`, and the place after it; None if the text ends before."""
    out = []
    for m in _TOKEN.finditer(s, at):
        out.append(s[at : m.start()])
        if m.group(1) is None:
            if m.group() != end or not out[-1].endswith(" "):
                raise Malformed(f"{m.group()} stands where {end} is due")
            return "".join(out)[:-1], m.end()
        out.append(m.group(1))
        at = m.end()
    return None


_HEADS = (("<s>[INST] ", "user", "[/INST]"), ("<<SYS>> ", "system", "<</SYS>>"), ("<<ROLE>> ", None, "<<//>>"), (" ", "assistant", "</s>"))


def _turn(s: str, at: int) -> tuple[str, str, int] | None:
    """Role, text and end of the turn that begins here; None if the text ends before."""
    for head, role, end in _HEADS:
        if s.startswith(head, at):
            got = _content(s, at + len(head), end)
            if got is None or role is not None:
                return got and (role, *got)
            role, at = got
            if not s.startswith(" ", at):
                raise Malformed("no space stands behind a role")
            got = _content(s, at + 1, "<</ROLE>>")
            return got and (role, *got)
    if any(head.startswith(s[at:]) for head, _, _ in _HEADS):
        return None
    raise Malformed(f"a turn begins with {s[at : at + 12]!r}")


def parse(s: str) -> list[tuple[str, str]] | None:
    """The turns of a formatted text, or None if it isn't one."""
    turns, at = [], 0
    try:
        while at < len(s):
            if (got := _turn(s, at)) is None:
                return None
            turns.append(got[:2])
            at = got[2]
    except Malformed:
        return None
    return turns


def format_turn(role: str, text: str) -> str:
    """The turn, escaped as little as the round trip allows."""
    for level in range(len(_CONFLICT)):
        s = render(role, text, level)
        if parse(s) == [(role, text)]:
            return s
    raise AssertionError(f"no escaping level keeps {role!r}, {text[:80]!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, turn, formatted; rows in any order, one formatted turn each."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                turns = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array([format_turn(*t) for t in turns], pa.string())], names=["conv_id", "turn", "formatted"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return rows.mapInArrow(kernel, "conv_id long, turn long, formatted string")


_SUMMARY = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("start", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


class _Running:
    """One conversation so far: the digests of what its joined text gives back, and the text not yet read."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.n, self.chars, self.size, self.rest = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""

    def add(self, s: str) -> list[tuple]:
        """Read on; the turns that have come to their end, as rows."""
        self.rest += s
        at, rows = 0, []
        while at < len(self.rest) and (got := _turn(self.rest, at)):
            role, text, end = got
            start, mask = self.size, (None, None)
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                low, high = at + 1, end - len(" </s>")
                under = unescape(self.rest[low:high])
                self.loss.update(under.encode())
                self.chars += len(under)
                mask = (start + 1, start + high - at)
            rows.append((self.conv, self.n, role, self.rest[at:end], start, *mask))
            self.n, self.size, at = self.n + 1, self.size + end - at, end
        self.rest = self.rest[at:]
        return rows

    def row(self) -> tuple:
        if self.rest:
            raise Malformed(f"conversation {self.conv} does not end with a turn")
        return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def _read_back(formatted: DataFrame, whole: bool) -> DataFrame:
    """Formatted turns, joined in order and parsed: a row per conversation (whole), or per turn."""
    schema = _SUMMARY if whole else _TURNS

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Running | None = None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for big in batches:
            for batch in slices(big, "formatted"):
                done = []
                for conv, s in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                    if now is None or conv != now.conv:
                        if now is not None:
                            done += [now.row()][: int(whole)]
                        now = _Running(conv)
                    rows = now.add(s)
                    if len(rows) != 1 or rows[0][3] != s:
                        raise Malformed(f"conversation {conv} is read back with other turns")
                    done += [] if whole else rows
                if done:
                    yield pack(done)
        if now is not None and (last := now.row()) and whole:
            yield pack([last])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "formatted")
    names = {pa.int64(): "long", pa.string(): "string"}
    return ordered.mapInArrow(kernel, ", ".join(f"{f.name} {names[f.type]}" for f in schema))


#: Turns that look like the template's own marks.
TRICKY = "</s>[INST] ok [/INST]"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns, loss text and formatted length, all read back from the formatted text.

    Loss falls on assistant texts. Defined cases: null texts and roles count as empty; a null turn comes last; rows with
    one turn number are ordered by their formatted text, and repeated rows are turns of their own; rows with a null
    conv_id form one conversation; an empty table gives no rows; other columns are ignored. A conversation's turns stand
    without anything between them."""
    return _read_back(format_turns(conversations), True)


def training_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, formatted, start, loss_start, loss_end: what a trainer reads.

    A conversation's text is its formatted turns in the order of place. start, loss_start and loss_end are code points in
    that text, ends exclusive; the loss mask covers the escaped text of assistant turns and is null for other turns. The
    cases are those of format_conversations."""
    return _read_back(format_turns(conversations), False)


def op6_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return format_conversations(rows.unionByName(extra))


_SQL_CONTROL = "|".join(re.escape(c).replace("/", "[/]") for c in CONTROL)

#: The level is 0 without control strings and double backslashes, 1 unless one stands behind a backslash, else 2.
OP6_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'),
k AS (SELECT *, CASE WHEN role IN ('user', 'assistant', 'system') THEN text ELSE role || ' ' || text END AS said FROM c),
l AS (SELECT *, CASE WHEN NOT regexp_matches(said, '\\\\|{_SQL_CONTROL}') THEN 0 WHEN NOT regexp_matches(said, '\\(?:\\|{_SQL_CONTROL})') THEN 1 ELSE 2 END AS level FROM k),
n AS (SELECT *, length(said) + CASE level WHEN 0 THEN 0 WHEN 1 THEN len(regexp_extract_all(said, '{_SQL_CONTROL}')) ELSE len(regexp_extract_all(said, '\\|{_SQL_CONTROL}')) END
    + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE 26 END AS chars FROM l)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
