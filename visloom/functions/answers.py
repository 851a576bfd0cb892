"""Reading answers, action calls and tagged blocks out of generated text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from visloom.functions.bind import bind

# The patterns of answers, numbers, named arguments and action calls.
# Word edges are spelled out, as what \b means for accented letters depends on the Java version.
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ANSWER = rf"(?i){WORD_START}(true|false){WORD_END}"
NUMBER = r"-?[0-9.]+(?:[eE][+-]?[0-9]+)?"
QUOTED = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
LIST = rf"\[(?:[^\[\]\"']|{QUOTED})*\]"
ANY_VALUE = rf"{QUOTED}|{LIST}|[^,()\[\]\"'\s]+"
ACTION = r"(?s)^\s*(?:[A-Za-z_][A-Za-z_0-9]*\.)*([A-Za-z_][A-Za-z_0-9]*)\((.*)\)\s*\z"
CALL = rf"(?:[A-Za-z_][A-Za-z_0-9]*\.)*[A-Za-z_][A-Za-z_0-9]*\((?:[^()\"']|{QUOTED})*\)"


def true_false(response: Column) -> Column:
    """First standalone true/false as ``True``/``False``; null when there is none."""
    word = F.lower(F.regexp_extract(response, ANSWER, 1))
    return F.when(word == "true", "True").when(word == "false", "False")


def action_name(call: Column) -> Column:
    """Function name of ``name(args)``, the last part of a dotted one; null when the text is not a call."""
    return F.nullif(F.regexp_extract(call, ACTION, 1), F.lit(""))


def action_calls(text: Column) -> Column:
    """Every call of a text in order, arguments included; brackets inside quoted strings do not end one."""
    return F.regexp_extract_all(text, F.lit(CALL), F.lit(0))


def _arguments(call: Column, value: str, convert: Callable[[Column], Column]) -> Column:
    """Map of the named arguments whose value matches; the last one wins when a name repeats.

    Quoted strings are skipped as a whole, so what looks like an argument inside one is none.
    """
    inside = F.regexp_extract(call, ACTION, 2)
    pattern = rf"{WORD_START}([A-Za-z_][A-Za-z_0-9]*)\s*=\s*({ANY_VALUE})"
    entries = F.transform(
        F.regexp_extract_all(inside, F.lit(pattern), F.lit(0)),
        lambda p: F.struct(
            F.regexp_extract(p, pattern, 1).alias("k"), F.regexp_extract(p, pattern, 2).alias("raw")
        ),
    )
    fitting = F.filter(entries, lambda e: e["raw"].rlike(rf"^(?:{value})$"))
    typed = F.transform(fitting, lambda e: F.struct(e["k"].alias("k"), convert(e["raw"]).alias("v")))

    def last_of_each(found: Column) -> Column:
        return F.filter(
            found,
            lambda e, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda later: later["k"] == e["k"]),
        )

    return F.map_from_entries(bind(typed, last_of_each))


def action_args(call: Column) -> Column:
    """Map of the numeric named arguments."""
    return _arguments(call, NUMBER, lambda raw: raw.try_cast("double"))


def action_texts(call: Column) -> Column:
    """Map of the quoted named arguments, without their quotes and escapes."""
    return _arguments(call, QUOTED, _unquoted)


def action_lists(call: Column) -> Column:
    """Map of the named list arguments, each as the texts of its items."""
    return _arguments(
        call, LIST, lambda raw: F.transform(F.regexp_extract_all(raw, F.lit(rf"{QUOTED}|{NUMBER}"), F.lit(0)), _unquoted)
    )


def _unquoted(raw: Column) -> Column:
    body = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.regexp_replace(body, r"\\(.)", "$1")


def action_number(call: Column, name: str) -> Column:
    """One numeric argument; null when absent or malformed."""
    value = F.regexp_extract(call, rf"{WORD_START}{name}\s*=\s*({NUMBER})", 1)
    return value.try_cast("double")


def blocks(text: Column, tag: str) -> Column:
    """Contents of every ``<tag>…</tag>``, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
