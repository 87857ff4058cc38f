"""Digests and the text normalisation before them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: the digests of no bytes, and the base32 alphabet
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def sha1_base32(data: Column) -> Column:
    """``sha1:`` and 32 base32 characters; five hex digits are 20 bits, so four characters."""
    code = F.sha1(data)
    symbols = []
    for k in range(8):
        bits = F.conv(F.substring(code, 5 * k + 1, 5), 16, 10).cast("int")
        symbols += [F.substr(F.lit(ALPHABET), F.shiftright(bits, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.when(data.isNotNull(), F.concat(F.lit("sha1:"), *symbols))


@F.pandas_udf(StringType())
def nfc(texts):
    """Unicode normalisation form C, which Spark has no function for."""
    import unicodedata

    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_for_digest(text: Column) -> Column:
    """Form C, line ends as LF, and no blanks (space, tab, no-break or ideographic space) at the ends of lines."""
    return F.regexp_replace(F.regexp_replace(nfc(text), "\r\n?", "\n"), "(?m)[ \t 　]+(?=\n|$(?![\\s\\S]))", "")


def digest_fields(fields: Column) -> Column:
    """A digest for each entry of a map, so that a change of one field leaves the others' digests alone."""
    return F.transform_values(fields, lambda _, v: F.sha2(v, 256))
