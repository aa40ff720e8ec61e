"""Dialogue records: reason codes, validation, serving rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import image_blobs, image_whole, occurrences

#: Image markers of stored and of normalised dialogues.
PAD, IMAGE = "<|image_pad|>", "<image>"

#: The end of a comparison's prompt before and after the rewrite, and that of a choice.
OLD_SUFFIX = "Answer with a single word or number."
NEW_SUFFIX = "Answer with exactly yes or no. Do not output a number or explanation."
CHOICE_SUFFIX = "Answer with only the option letter (A, B, C, or D). Do not include any explanation."


def dialogues(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) from rows by turn."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(m.alias("messages"))


def normalised(messages: str = "messages", text: str = "text") -> Column:
    """Turns with the image marker in one form and texts trimmed; a null text stays null."""
    trim = lambda c: F.regexp_replace(F.replace(c, F.lit(PAD), F.lit(IMAGE)), r"(?U)\A\s+|\s+\z", "")
    return F.transform(messages, lambda t: F.struct(t["role"].alias("role"), trim(t[text]).alias("content")))


def reason(turns: str = "turns", tools: Column | None = None, images: Column | None = None, placeholder: Column | None = None, broken: Column | None = None) -> Column:
    """First reason to reject a dialogue, else ``accepted``; the order of the tests is part of the result.

    ``tools`` tells that a turn calls tools, ``images`` is the number of images, ``placeholder``
    that the only one is a blank, ``broken`` that it cannot be read; without them there are none.
    """
    no = F.lit(False)
    tools, images, placeholder = tools if tools is not None else no, images if images is not None else F.lit(0), placeholder if placeholder is not None else no
    broken = broken if broken is not None else no
    roles = F.array_join(F.transform(turns, lambda t: F.coalesce(t["role"], F.lit(""))), ",")
    user = F.get(F.filter(turns, lambda t: t["role"] == "user"), F.lit(0))["content"]
    answer = F.try_element_at(F.col(turns), F.lit(-1))["content"]
    markers = F.aggregate(F.transform(turns, lambda t: occurrences(t["content"], IMAGE)), F.lit(0).cast("long"), lambda a, x: a + x)
    with_image = (markers == 1) & F.contains(user, F.lit(IMAGE)) & (images == 1) & ~placeholder
    text_only = (markers == 0) & ((images == 0) | placeholder)
    return (
        F.when(F.col(turns).isNull() | F.exists(turns, lambda t: t.isNull()), "invalid_dialogue")
        .when(~roles.isin("user,assistant", "system,user,assistant"), "unsupported_dialogue")
        .when(F.exists(turns, lambda t: t["content"].isNull()), "invalid_content")
        .when(tools, "tool_sample")
        .when((user == "") | (answer == "") | F.contains(answer, F.lit(IMAGE)), "invalid_qa")
        .when(images > 1, "multi_image")
        .when((images == 1) & broken, "parse_or_image_error")
        .when(with_image | text_only, "accepted")
        .otherwise("ambiguous_modality")
    )


def conversation_errors(conversations: Column, images: Column) -> Column:
    """All errors of a serving row: of its JSON conversations, else of its turns and its list of images."""
    blobs = image_blobs(images)
    turns = F.from_json(conversations, "array<struct<role:string,content:string>>")
    broken = (
        F.when(F.try_parse_json(conversations).isNull(), "invalid_conversations_json")
        .when(turns.isNull() | (F.size(turns) == 0), "conversations_not_nonempty_list")
        .when(F.exists(turns, lambda t: t["role"].isNull() | ~t["role"].isin("user", "assistant", "system")), "invalid_role")
        .when(F.exists(turns, lambda t: t["content"].isNull()), "content_not_string")
    )
    has = lambda role: F.exists(turns, lambda t: t["role"] == role)
    further = F.array_compact(
        F.array(
            F.when(~F.exists(turns, lambda t: (t["role"] != "system") & F.contains(t["content"], F.lit(IMAGE))), "missing_image_token"),
            F.when(~has("user"), "missing_user_turn"),
            F.when(~has("assistant"), "missing_assistant_turn"),
        )
    )
    pictures = F.array_compact(
        F.array(
            F.when(blobs.isNull() | (F.size(blobs) == 0), "missing_image_bytes"),
            F.when(F.exists(blobs, lambda x: ~image_whole(x)), "invalid_image_bytes"),
        )
    )
    return F.concat(F.when(broken.isNotNull(), F.array(broken)).otherwise(further), pictures)


def serving_conversations(question: Column, answer: Column) -> Column:
    """JSON of a user turn with the image token and an assistant turn."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.array(turn("user", F.concat(question, F.lit("\n" + IMAGE))), turn("assistant", answer)))


def rewrite_suffix(text: Column, applies: Column, role: Column, name: Column, old: str = OLD_SUFFIX, new: str = NEW_SUFFIX) -> tuple[Column, Column]:
    """(text, changed): the old suffix replaced once; rows that have the new one or do not apply are left alone.

    A row that applies but whose role is not ``user``, or that ends in neither suffix, is an error with its name.
    """
    base = F.substring(text, F.lit(1), F.length(text) - len(old))
    fail = lambda what: F.raise_error(F.concat(F.lit(what + ": "), name.cast("string")))
    moved = F.when(~applies | text.endswith(new), text).when(text.endswith(old), F.concat(base, F.lit(new))).otherwise(fail("prompt has an unexpected suffix"))
    text_out = F.when(applies & ~role.eqNullSafe(F.lit("user")), fail("first message is not the user's")).otherwise(moved)
    return text_out, applies & ~text.endswith(new) & text.endswith(old)


def choice_prompt(question: Column) -> Column:
    """The prompt of a multiple-choice question with one image; markers within the question become words."""
    plain = F.replace(F.replace(question, F.lit("<image 1>"), F.lit("the image")), F.lit(IMAGE), F.lit("the image"))
    return F.concat(F.lit(IMAGE + "\n"), plain, F.lit("\n" + CHOICE_SUFFIX))


def with_duplicates(parsed: DataFrame, sample_id: str, order: str) -> DataFrame:
    """``parsed`` (with reason) where accepted rows whose sample was accepted before, by ``order``, are ``duplicate``."""
    ok = F.col("reason") == "accepted"
    first = parsed.where(ok).groupBy(F.col(sample_id).alias("_sample")).agg(F.min(order).alias("_first"))
    joined = parsed.join(first, ok & (F.col(sample_id) == F.col("_sample")), "left")
    return joined.withColumn("reason", F.when(ok & (F.col(order) > F.col("_first")), "duplicate").otherwise(F.col("reason"))).drop("_sample", "_first")


def sample_group(turns: str, image: Column) -> Column:
    """``image:`` and the hash of the image, else ``text:`` and that of the turns before the answer."""
    prompt = F.to_json(F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))))
    return F.when(image.isNotNull(), F.concat(F.lit("image:"), F.sha2(image, 256))).otherwise(F.concat(F.lit("text:"), F.sha2(prompt, 256)))
