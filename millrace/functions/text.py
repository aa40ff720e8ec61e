"""Text functions as column builders; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answer vocabularies by group.
COLORS = ("blue", "brown", "cyan", "gray", "green", "purple", "red", "yellow")
MATERIALS = ("metal", "rubber")
SHAPES = ("cube", "cylinder", "sphere")
SIZES = ("large", "small")
RELATIONS = ("left", "right", "front", "behind", "above", "below")
COMPARISONS = ("equal_integer", "greater_than", "less_than")
BOOLEAN_OPS = ("exist", "equal_color", "equal_material", "equal_shape", "equal_size")


def normalise_v1(c: Column) -> Column:
    """Lower case, trimmed, without full stops at the end, white space collapsed."""
    c = F.regexp_replace(F.lower(c), r"(?U)\A\s+|\s+\z", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[.。]+\z", ""), r"(?U)\s+", " ")
    return F.regexp_replace(c, r"\A +| +\z", "")


def normalise_v2(c: Column) -> Column:
    """Lower-case first line, letters, digits and underscores only."""
    c = F.regexp_replace(F.lower(c), r"(?U)\A\s+|\s+\z", "")
    first = F.get(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), F.lit(0))
    return F.regexp_replace(first, r"[^\p{L}\p{N}_]+", "")


def parse_letter(c: Column) -> Column:
    """The letter of an answer that is just A to D, bare or in brackets, else null."""
    pattern = r"\A(?U)\s*(?:([A-Da-d])|\(([A-Da-d])\)|\[([A-Da-d])\])[.。]?\s*\z"
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(c, pattern, k), F.lit("")) for k in (1, 2, 3)]))


def short_answer(c: Column, max_words: int = 3, applies: Column | None = None) -> Column:
    """Whether a text is one to three plain words, or a number in any digits; false where it does not apply."""
    t = F.regexp_replace(F.lower(F.upper(c)), r"\A\.+|\.+\z", "")  # both, as one capital may stand for two small letters
    words = F.size(F.split(F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+"))
    short = (words <= max_words) & (t.rlike(r"\A[a-z]+([ -][a-z]+){0,2}\z") | t.rlike(r"(?U)\A\d+(\.\d+)?\z"))
    return short if applies is None else F.coalesce(applies, F.lit(False)) & short


def task_of(function: Column) -> Column:
    """Task of a program from its last function."""
    return (
        F.when(function.startswith("query_"), F.replace(function, F.lit("query_"), F.lit("")))
        .when(function == "count", "count")
        .when(function.isin(*COMPARISONS), "comparison")
        .when(function.isin(*BOOLEAN_OPS), "boolean_or_attribute")
        .otherwise("other")
    )


def answer_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("yes", "no"), "boolean").when(c.rlike(r"(?U)\A\d+\z"), "integer").otherwise("attribute")


def difficulty(length: Column, relations: Column) -> Column:
    return (
        F.when((length <= 9) & (relations <= 1), "easy")
        .when((length <= 15) & (relations <= 2), "medium")
        .when((length <= 20) & (relations <= 3), "hard")
        .otherwise("very_hard")
    )


def answer_group(c: Column) -> Column:
    """Answer space of a normalised answer."""
    c = normalise_v2(c)
    return (
        F.when(c.rlike(r"(?U)\A\d+\z"), "integer")
        .when(c.isin(*COLORS), "color")
        .when(c.isin(*MATERIALS), "material")
        .when(c.isin(*SHAPES), "shape")
        .when(c.isin(*SIZES), "size")
        .when(c.isin("yes", "no"), "boolean")
        .otherwise("other")
    )


def occurrences(c: Column, marker: str) -> Column:
    """How often a marker stands in a text."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def image_format(magic: Column) -> Column:
    """Format of an image from its first bytes."""
    h = F.hex(magic)
    return F.when(h.startswith("FFD8FF"), "JPEG").when(h.startswith("89504E470D0A1A0A"), "PNG").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "WEBP")


def image_blobs(images: Column) -> Column:
    """The images of a row that are not null."""
    return F.filter(images, lambda x: x.isNotNull())


def image_whole(data: Column) -> Column:
    """Whether bytes begin and end as an image of their format must; pixels are not decoded."""
    kind, h = image_format(data), F.hex(data)
    size = F.concat(*[F.substring(h, at, 2) for at in (15, 13, 11, 9)])  # bytes after the first eight, little-endian
    ends = F.when(kind == "JPEG", h.endswith("FFD9")).when(kind == "PNG", h.endswith("49454E44AE426082")).when(kind == "WEBP", F.conv(size, 16, 10).cast("long") == F.octet_length(data) - 8)
    return F.coalesce(ends, F.lit(False))
