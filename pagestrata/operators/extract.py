"""Rows out of semi-structured HTML: slices by container, ids and times, links, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL = "\u0001"


def slices(html: Column, container: str) -> Column:
    """The page from each container match up to the next."""
    marked = F.regexp_replace(html, f"({container})", f"{SENTINEL}$1")
    return F.slice(F.split(marked, SENTINEL), F.lit(2), F.greatest(F.size(F.split(marked, SENTINEL)) - 1, F.lit(0)))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def item_pairs(pages: DataFrame, key: str, html: str, container: str, id_pattern: str, time_pattern: str) -> DataFrame:
    """(key, pos, item_id, item_time): the first id and time of each slice; slices without id go, later repeats of an id on the page go."""
    parts = pages.select(key, F.posexplode(slices(F.col(html), container)).alias("pos", "part"))
    found = parts.select(key, "pos", _first(F.col("part"), id_pattern).alias("item_id"), _first(F.col("part"), time_pattern).alias("item_time")).where("item_id is not null")
    firsts = found.groupBy(key, "item_id").agg(F.min(F.struct("pos", "item_time")).alias("f"))
    return firsts.select(key, F.col("f.pos").alias("pos"), "item_id", F.col("f.item_time").alias("item_time"))


def idless_count(pages: DataFrame, key: str, html: str, container: str, id_pattern: str, time_pattern: str) -> DataFrame:
    """Slices of each page with a time but no id."""
    n = F.size(F.filter(slices(F.col(html), container), lambda p: _first(p, id_pattern).isNull() & _first(p, time_pattern).isNotNull()))
    return pages.select(key, n.alias("idless"))


def item_ids(html: Column, pattern: str) -> Column:
    """Distinct, in the order first seen."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def item_times(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def count_matches(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern))


def claimed_count(html: Column, pattern: str) -> Column:
    """struct(count, raw): the pattern's second group is the number; null without a match."""
    raw = F.regexp_extract(html, pattern, 0)
    return F.when(raw != "", F.struct(F.regexp_extract(html, pattern, 2).try_cast("long").alias("count"), raw.alias("raw")))


def pagination(html: Column, pattern: str) -> Column:
    """struct(page, total_pages), both at least 1; null otherwise."""
    page = F.regexp_extract(html, pattern, 1).try_cast("decimal(20,0)")
    total = F.regexp_extract(html, pattern, 2).try_cast("decimal(20,0)")
    return F.when((page >= 1) & (total >= 1), F.struct(page.alias("page"), total.alias("total_pages")))


def strip_elements(html: Column, tags: str, marked: str) -> Column:
    """The page without elements of these tags whose start tag matches ``marked`` (up to the first end tag of the same name)."""
    return F.regexp_replace(html, rf"(?s)<({tags})\b[^>]*{marked}[^>]*>.*?</\1>", "")


def links(html: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def cover_image(html: Column, container: str, source: str, placeholder: str, reach: int = 800) -> Column:
    """struct(url, reason): the first image within ``reach`` characters of the container."""
    at = F.regexp_instr(html, F.lit(container))
    url = F.when(at > 0, _first(F.substr(html, at, F.lit(reach)), source))
    reason = F.when(url.isNull(), "not_found").when(url.rlike(placeholder), "placeholder").otherwise("ok")
    return F.struct(F.when(reason == "ok", url).alias("url"), reason.alias("reason"))


def embedded_images(html: Column, block: str, source: str, caption: str) -> Column:
    """Map of image URL to caption; the first caption of a URL stays."""
    found = F.transform(F.regexp_extract_all(html, F.lit(block), F.lit(0)), lambda b: F.struct(_first(b, source).alias("key"), F.coalesce(_first(b, caption), F.lit("")).alias("value")))
    found = F.filter(found, lambda e: e["key"].isNotNull())
    keys = F.array_distinct(F.transform(found, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), 1)["value"]))


def status_photos(pages: DataFrame, key: str, html: str, wrapper: str, owner_pattern: str, photos_pattern: str, owner: str) -> DataFrame:
    """Photos of the owner's own posts, from the JSON list in each: the raw image if there is one, else the large one; and counts of the rest."""
    if not owner:
        raise ValueError("an owner is required: else other people's photos come along")
    parts = pages.select(key, F.posexplode(slices(F.col(html), wrapper)).alias("pos", "part"))
    listed = F.from_json(F.nullif(F.regexp_extract("part", photos_pattern, 1), F.lit("")), "array<struct<raw:string,large:string>>")
    owned = parts.select(key, "pos", (_first(F.col("part"), owner_pattern) == owner).alias("own"), listed.alias("photos"))
    urls = F.filter(F.transform(F.coalesce("photos", F.array().cast("array<struct<raw:string,large:string>>")), lambda p: F.coalesce(p["raw"], p["large"])), lambda u: u.isNotNull())
    rows = owned.select(key, "pos", F.coalesce("own", F.lit(False)).alias("own"), urls.alias("urls"), F.size(F.coalesce("photos", F.array().cast("array<struct<raw:string,large:string>>"))).alias("n"))
    return rows.groupBy(key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("pos", "urls")))), lambda e: e["urls"])).alias("urls"),
        F.sum(F.when(~F.col("own"), 1).otherwise(0)).alias("skipped_others"),
        F.sum(F.when(F.col("own"), F.col("n") - F.size("urls")).otherwise(0)).alias("unresolved"),
    )


def generate_urls(routes: DataFrame, template: str = "template", first: str = "first", last: str = "last", step: str = "step") -> DataFrame:
    """One row for each offset of each route, with ``{offset}`` filled in."""
    offsets = F.sequence(F.col(first), F.col(last), F.col(step))
    return routes.withColumn("offset", F.explode(offsets)).withColumn("url", F.replace(F.col(template), F.lit("{offset}"), F.col("offset").cast("string")))


def merge_list_pages(pages: DataFrame, key: str, start: str, items: str) -> DataFrame:
    """The items of each list's pages in page order, the pages that had any, and null instead of no items."""
    put = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("at"), F.col(items).alias("held")))), lambda p: p["held"]))
    out = pages.groupBy(key).agg(put.alias("items"), F.sum(F.when(F.size(items) > 0, 1).otherwise(0)).alias("pages_with_items"))
    return out.withColumn("items", F.when(F.size("items") > 0, F.col("items")))


def sample_failures(sample: DataFrame, kind: str, failed: Column) -> DataFrame:
    """Pages of each kind in a sample, and those that could not be rendered."""
    return sample.groupBy(kind).agg(F.count("*").alias("pages"), F.sum(F.when(F.coalesce(failed, F.lit(True)), 1).otherwise(0)).alias("failures"))


def render_sample(captures: DataFrame, kind: str, order: str, limit: int = 30) -> DataFrame:
    """The first pages of each content kind."""
    from pyspark.sql import Window

    return captures.withColumn("turn", F.row_number().over(Window.partitionBy(kind).orderBy(order))).where(F.col("turn") <= limit).drop("turn")
