"""Chat messages, their default rendering, and training arrays, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visloom.functions.bind import bind
from visloom.functions.text import hashed_token_id, tokens
from visloom.schemas import CONTENT, IMAGE, MESSAGE

# Ignored-label marker, end-of-turn and image placeholder tokens,
# and the special tokens that stand for image content.
IGNORE = -100
TURN_END = "<|end|>"
IMAGE_TOKEN = "<image>"
IMAGE_TOKENS = ["<image>", "<fake_token_around_image>", "<global-img>"]


def _text_part(text: Column) -> Column:
    return F.struct(
        F.lit("text").alias("type"), F.lit(None).cast(IMAGE).alias("image"), text.alias("text")
    ).cast(CONTENT)


def _image_part(image: Column) -> Column:
    return F.struct(
        F.lit("image").alias("type"), image.alias("image"), F.lit(None).cast("string").alias("text")
    ).cast(CONTENT)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content")).cast(MESSAGE)


def user_content(images: Column, text: Column) -> Column:
    """One image part per image, then the text part."""
    return F.concat(F.transform(images, _image_part), F.array(_text_part(text)))


def conversation(images: Column, text: Column, system: Column | None = None) -> Column:
    """A user message, after a system message when the system text is not empty."""
    user = F.array(_message("user", user_content(images, text)))
    if system is None:
        return user
    lead = F.array(_message("system", F.array(_text_part(system))))
    return F.concat(F.when(F.coalesce(system, F.lit("")) != "", lead).otherwise(F.slice(lead, 1, 0)), user)


def attach_response(messages: Column, response: Column) -> Column:
    """The messages with an assistant turn at the end."""
    return F.concat(messages, F.array(_message("assistant", F.array(_text_part(response)))))


def gui_messages(dataset: Column, image: Column, system: Column, user: Column, assistant: Column) -> Column:
    """Messages of a GUI record; stage 1 never carries a system turn."""
    system_text = F.when(dataset != "stage1", system)
    prompt = conversation(F.array(image), F.coalesce(user, F.lit("")), system_text)
    return attach_response(prompt, F.coalesce(assistant, F.lit("")))


def _turn_tokens(message: Column) -> Column:
    body = F.flatten(
        F.transform(
            message["content"],
            lambda part: F.when(part["type"] == "image", F.array(F.lit(IMAGE_TOKEN))).otherwise(
                tokens(part["text"])
            ),
        )
    )
    opening = F.concat(F.lit("<|"), message["role"], F.lit("|>"))
    return F.concat(F.array(opening), body, F.array(F.lit(TURN_END)))


def render(messages: Column) -> Column:
    """Token strings of a conversation under the default template."""
    return F.flatten(F.transform(messages, _turn_tokens))


def render_prompt(messages: Column) -> Column:
    """Tokens before the last turn."""
    return render(F.slice(messages, 1, F.size(messages) - 1))


def render_last(messages: Column) -> Column:
    """Tokens of the last turn, its opening included."""
    return _turn_tokens(F.element_at(messages, -1))


def token_ids(rendered: Column) -> Column:
    return F.transform(rendered, hashed_token_id)


def response_labels(ids: Column, prompt_length: Column) -> Column:
    """The ids with every prompt position replaced by the ignore marker."""
    return bind(
        prompt_length, lambda p: F.transform(ids, lambda x, i: F.when(i < p, F.lit(IGNORE)).otherwise(x))
    )


def scoring_labels(ids: Column, prompt_length: Column, pad_id: int | Column = 0) -> Column:
    """Labels for scoring: prompt, padding and the very first position are ignored."""
    ignored = F.struct(prompt_length.alias("prompt"), (F.lit(pad_id) if isinstance(pad_id, int) else pad_id).alias("pad"))
    return bind(
        ignored,
        lambda g: F.transform(
            ids, lambda x, i: F.when((i < g["prompt"]) | (i == 0) | (x == g["pad"]), F.lit(IGNORE)).otherwise(x)
        ),
    )


def padded(values: Column, length: Column, fill: int) -> Column:
    """Extend an array with ``fill`` up to ``length``."""
    return F.concat(values, F.array_repeat(F.lit(fill), (length - F.size(values)).cast("int")))
