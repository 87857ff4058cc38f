"""Names of captures, bundles and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the shapes of ids and file names
BUNDLE_ID = "^[0-9]{8}T[0-9]{6}Z-[0-9a-f]{6}$"
SEGMENT_KINDS = ("data", "assets", "catalog")
SEQUENCE_WIDTH = 6
SEGMENT_WIDTH = 5
DIRECTORY_PREFIX = "bundle-"


def padded(number: Column, width: int) -> Column:
    """Zero-padded to ``width``, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def capture_id(bundle_id: Column, seq: Column) -> Column:
    return F.concat(bundle_id, F.lit("#"), padded(seq, SEQUENCE_WIDTH))


def capture_bundle(capture: Column) -> Column:
    return F.nullif(F.regexp_extract(capture, "^(.+)#([0-9]{6,})$", 1), F.lit(""))


def capture_seq(capture: Column) -> Column:
    return F.nullif(F.regexp_extract(capture, "^(.+)#([0-9]{6,})$", 2), F.lit("")).try_cast("long")


def is_bundle_id(text: Column) -> Column:
    return text.rlike(BUNDLE_ID)


def new_bundle_id(at: Column, suffix: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), suffix)


def bundle_time(bundle_id: Column) -> Column:
    """The instant in a bundle id; null if it isn't one."""
    return F.when(is_bundle_id(bundle_id), F.try_to_timestamp(F.substring(bundle_id, 1, 15), F.lit("yyyyMMdd'T'HHmmss")))


def directory_name(bundle_id: Column, prefix: str = DIRECTORY_PREFIX) -> Column:
    return F.concat(F.lit(prefix), bundle_id)


def bundle_of_directory(name: Column, prefix: str = DIRECTORY_PREFIX) -> Column:
    rest = F.when(F.startswith(name, F.lit(prefix)), F.substr(name, F.lit(len(prefix) + 1)))
    return F.when(is_bundle_id(rest), rest)


def index_filename(bundle_id: Column) -> Column:
    return F.concat(F.lit("index-"), bundle_id, F.lit(".ndjson"))


def segment_filename(kind: Column, bundle_id: Column, number: Column) -> Column:
    return F.concat(kind, F.lit("-"), bundle_id, F.lit("-"), padded(number, SEGMENT_WIDTH), F.lit(".warc.gz"))


def segment_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "-([0-9]{5,})\\.warc\\.gz$", 1), F.lit("")).try_cast("long")


def segment_kind(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "^([a-z]+)-", 1), F.lit(""))
