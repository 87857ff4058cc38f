"""Small text and byte functions: labels, sizes, entities, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: first bytes of images, in hex
IMAGE_MAGIC = ("FFD8FF", "89504E47", "47494638", "424D")
LEAST_IMAGE_BYTES = 12
PLACEHOLDER_WORDS = "default|placeholder|blank"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _scaled(n: Column, unit: int, digits: int) -> Column:
    """n / unit with so many decimals, halves up, in whole numbers."""
    steps = 10**digits
    parts = F.call_function("div", n * (2 * steps) + unit, F.lit(2 * unit).cast("long"))
    return F.concat(F.call_function("div", parts, F.lit(steps).cast("long")).cast("string"), F.lit("."), F.lpad((parts % steps).cast("string"), digits, "0"))


def human_bytes(n: Column) -> Column:
    """B, KB and MB with one decimal, GB with two."""
    n = n.cast("long")
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.concat(_scaled(n, kb, 1), F.lit(" KB")))
        .when(n < gb, F.concat(_scaled(n, mb, 1), F.lit(" MB")))
        .otherwise(F.concat(_scaled(n, gb, 2), F.lit(" GB")))
    )


def short_id(capture: Column) -> Column:
    return F.substring_index(capture, "#", -1)


@F.pandas_udf(StringType())
def decode_entities(texts):
    """Each entity once, from left to right, so ``&amp;lt;`` becomes ``&lt;``; unknown ones stay."""
    import re

    pattern = re.compile("&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);")

    def one(m):
        name = m[1]
        if name[0] != "#":
            return ENTITIES.get(name, m[0])
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return texts.map(lambda t: pattern.sub(one, t), na_action="ignore")


def looks_like_image(data: Column) -> Column:
    """By the first bytes: JPEG, PNG, GIF, BMP, or WEBP in its container."""
    head = F.hex(F.substring(data, 1, LEAST_IMAGE_BYTES))
    known = F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250")
    for magic in IMAGE_MAGIC:
        known = known | F.startswith(head, F.lit(magic))
    return F.coalesce((F.octet_length(data) >= LEAST_IMAGE_BYTES) & known, F.lit(False))


def is_placeholder_image(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(PLACEHOLDER_WORDS), F.lit(False))
