"""Chat formatting that proves itself: what is written is parsed back and compared.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. The parser is deterministic: it cuts
at these strings, refuses anything else between turns, and takes one backslash out of
every ``<\\…|``. A text is first written as it is. Turns that do not come back identical are
written escaped (one backslash more in every ``<…|``), until everything comes back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.llm.common import ship

START, STOP = "<|im_start|>", "<|im_end|>"
OPEN = re.compile(r"<(\\*)\|")
OPEN_ESCAPED = re.compile(r"<\\(\\*)\|")
LOSS_ROLE = "assistant"

Turn = tuple[str, str]


class Malformed(ValueError):
    """A string that is not a sequence of turns."""


def escaped(text: str) -> str:
    return OPEN.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return OPEN_ESCAPED.sub(r"<\1|", text)


def role_written(role: str) -> str:
    """A role on one line without control strings; ordinary roles stay as they are."""
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def role_read(text: str) -> str:
    return re.sub(r"\\([\\nl])", lambda m: {"\\": "\\", "n": "\n", "l": "<"}[m[1]], text)


def parse(text: str) -> list[tuple[str, str, tuple[int, int]]]:
    """Role, text and the place of the written text of each turn."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise Malformed(f"no turn starts at {at}")
        line = text.find("\n", at)
        stop = text.find(STOP, line)
        if line < 0 or stop < 0 or not text.startswith("\n", stop + len(STOP)):
            raise Malformed(f"the turn at {at} does not end")
        body = text[line + 1 : stop]
        if START in body:
            raise Malformed(f"a turn starts inside the turn at {at}")
        out.append((role_read(text[at + len(START) : line]), unescaped(body), (line + 1, stop)))
        at = stop + len(STOP) + 1
    return out


def written(turns: list[Turn], escape: list[bool]) -> str:
    return "".join(
        f"{START}{role_written(role)}\n{escaped(text) if e else text}{STOP}\n"
        for (role, text), e in zip(turns, escape, strict=True)
    )


def comes_back(role: str, text: str, escape: bool) -> bool:
    """Whether a turn on its own survives writing and parsing."""
    try:
        return [p[:2] for p in parse(written([(role, text)], [escape]))] == [(role, text)]
    except Malformed:
        return False


def rendered(turns: list[Turn]) -> str:
    """The turns as one string that parses back to them, with as little escaping as it takes."""
    escape = [False] * len(turns)
    while True:
        out = written(turns, escape)
        try:
            if [p[:2] for p in parse(out)] == turns:
                return out
        except Malformed:
            pass
        conflicts = [e or not comes_back(role, text, False) for (role, text), e in zip(turns, escape, strict=True)]
        if conflicts == escape:  # no single turn is to blame: write all of them escaped
            if all(escape):
                raise Malformed("escaped turns do not come back")
            conflicts = [True] * len(turns)
        escape = conflicts


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """The places of assistant texts in the formatted string: what the loss mask covers."""
    return [span for role, _, span in parse(formatted) if role == LOSS_ROLE]


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id: ``formatted`` and ``loss_spans`` (begin, end in code points).

    ``turns`` has conv_id, turn, role, text; other columns are not read. Null texts and roles are empty.
    Turns are in order of turn, then role, then text, so repeated rows stay and ties have an order;
    null turns come first, rows with a null conv_id form one conversation. An empty table gives no rows.
    A conversation is one string, so it is put together in one place: its size is that of the output row.
    """
    ship(turns.sparkSession)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = turns.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("turn").alias("turn"), value("role").alias("role"), value("text").alias("text")))
        ).alias("turns")
    )
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))

    def write(batches):
        for batch in batches:
            texts = [rendered([tuple(t.values()) for t in turns]) for turns in batch.column(1).to_pylist()]
            spans = [[{"begin": a, "end": b} for a, b in loss_spans(t)] for t in texts]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"]
            )

    return whole.mapInArrow(write, "conv_id long, formatted string, loss_spans array<struct<begin:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """From conv_id, formatted and loss_spans: turn and loss digests taken from the output alone."""
    ship(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                turns = parse(text)
                told = "".join(f"{role}\n{said}\n" for role, said, _ in turns)
                masked = "".join(unescaped(text[s["begin"] : s["end"]]) for s in spans)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (told, masked)]
                rows.append((conv_id, len(turns), digests[0], len(masked), digests[1], len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read, schema)
