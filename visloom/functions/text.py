"""String expressions: whitespace, prompts, ids, ordering keys, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode whitespace, as Python strips it.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The token separator and the default prompt.
TOKEN_SEPARATOR = r"[ \t\n\r\f\x{0B}]+"
PAIR_PROMPT = (
    "You are given two images. Decide whether the statement is true.\n"
    "Statement: {statement}\nAnswer with either True or False."
)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends; only the ends of the text are looked at."""
    return F.btrim(text, F.lit(WHITESPACE))


def pair_prompt(statement: Column, template: str = PAIR_PROMPT) -> Column:
    """Put the stripped statement into a template holding ``{statement}``."""
    return F.replace(F.lit(template), F.lit("{statement}"), strip(statement))


def tokens(text: Column) -> Column:
    """Whitespace tokens of a text as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), TOKEN_SEPARATOR), "")


def hashed_token_id(token: Column) -> Column:
    """Stable positive id from 63 bits of the token's md5; 0 stays free for padding."""
    first = F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("bigint")  # as a signed number
    return F.greatest(F.shiftrightunsigned(first, 1), F.lit(1))


def order_key(seed: int, key: Column) -> Column:
    """Pseudo-random but repeatable sort key: the same for any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def example_uid(uid: Column, identifier: Column, id_: Column) -> Column:
    """First usable of uid, identifier, id; the empty string and the number zero are unusable except for id."""

    def usable(value: Column) -> Column:
        text = value.cast("string")
        zero = (F.typeof(value) != "string") & F.coalesce(text.try_cast("double") == 0, F.lit(False))
        return F.when((text != "") & ~zero, text)

    return F.coalesce(usable(uid), usable(identifier), id_.cast("string"))


def fallback_uid(split: Column, sentence: Column) -> Column:
    """``{split}-{8 hex digits}`` from the sentence, stable between runs."""
    return F.concat(split, F.lit("-"), F.substring(F.md5(sentence), 1, 8))


def clean_label(label: Column) -> Column:
    """``True`` / ``False`` from a string or bool label; null when it is neither."""
    text = F.lower(strip(label.cast("string")))
    return F.when(text == "true", "True").when(text == "false", "False")


def make_sample_id(dataset: Column, config: Column, split: Column, index: Column) -> Column:
    """``dataset:config:split:00000042``; longer positions keep all their digits."""
    return F.format_string("%s:%s:%s:%08d", dataset, config, split, index)


def parse_sample_id(sample_id: Column) -> Column:
    """Struct(dataset, config, split, index); null unless 4 parts with an integer index."""
    parts = F.split(sample_id, ":")
    index = F.try_element_at(parts, F.lit(4)).try_cast("bigint")
    parsed = F.struct(
        F.get(parts, 0).alias("dataset"),
        F.get(parts, 1).alias("config"),
        F.get(parts, 2).alias("split"),
        index.alias("index"),
    )
    return F.when((F.size(parts) == 4) & index.isNotNull(), parsed)
