"""Routes of a site as a table, in the order in which they are worked through, and the queue items that a run starts with.

The registry is data: keys, order, paging and paths. Host and account are parameters, and other sites pass rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata import schemas
from pagestrata.functions.urls import url_key

# fixed values: priorities, media with the states of their marks, and the paths of entry pages
IDENTITY, TIMELINE, LONGFORM, IMAGES, MARKS, CATALOG = 0, 10, 20, 30, 40, 90
DEFAULT_PRIORITY = 50
MARK_STATES = {"movie": ("collect", "wish", "do"), "book": ("collect", "wish", "do"), "music": ("collect", "wish", "do"), "game": ("collect", "wish", "do"), "drama": ("collect", "wish")}
OVERVIEWS = {
    "movie": "https://movie.{site}/people/{user}/", "book": "https://book.{site}/people/{user}/", "music": "https://music.{site}/people/{user}/",
    "game": "https://www.{site}/people/{user}/games", "drama": "https://www.{site}/location/people/{user}/drama/",
}
MARK_PAGES = {
    "movie": "https://movie.{site}/people/{user}/{state}?start={offset}&sort=time&rating=all&mode=grid&type=all&filter=all",
    "book": "https://book.{site}/people/{user}/{state}?start={offset}&sort=time&rating=all&filter=all&mode=grid",
    "music": "https://music.{site}/people/{user}/{state}?start={offset}&sort=time&rating=all&filter=all&mode=grid",
    "game": "https://www.{site}/people/{user}/games?action={state}&start={offset}",
    "drama": "https://www.{site}/location/people/{user}/drama/{state}?sort=time&start={offset}&filter=all&mode=grid&tags_sort=count",
}
MARK_STEP, LIST_STEP = 15, 25
FULL, BOUNDED = "full", "bounded"
AFTER_TIMELINE = ("broadcast.timeline",)


def _route(key: str, priority: int, template: str | None = None, intent: str | None = None, kind: str = "data", surface: str = "html", enumeration: str = FULL, paging: tuple[str, int | None, int] | None = None, ordered: bool | None = None, requires: tuple[str, ...] = ()) -> tuple:
    return (key, intent or key, kind, surface, priority, "archive", enumeration, "contiguity", paging, ordered, list(requires), template)


def default_routes(media: tuple[str, ...] = tuple(MARK_STATES), catalog: bool = True) -> list[tuple]:
    """Rows of ``schemas.ROUTE``. A paging step of null means as many as the page has items."""
    own = "https://www.{site}/people/{user}/"
    rows = [_route("profile.overview", IDENTITY, own), _route("broadcast.timeline", TIMELINE, own + "statuses?p={offset}", enumeration=BOUNDED, paging=("page", 1, 1))]
    rows += [_route(f"profile.category_entry.{m}", IDENTITY, OVERVIEWS[m]) for m in media]
    rows += [_route(f"asset.{name}", IMAGES, intent="asset.image.user_upload", kind="assets", surface="asset", enumeration=BOUNDED, ordered=False) for name in ("status_photo", "longform_embed")]
    for name in ("note", "review"):
        rows += [_route(f"{name}.list", LONGFORM, own + f"{name}s?start={{offset}}", paging=("start", None, 0)), _route(f"{name}.item", LONGFORM + 1, ordered=False)]
    rows += [_route("doulist.list", LONGFORM + 2, own + "doulists/all?start={offset}", intent="doulist.list.created", paging=("start", None, 0)), _route("doulist.item", LONGFORM + 3, paging=("start", LIST_STEP, 0))]
    rows += [_route(f"interest.{m}.{state}", MARKS, MARK_PAGES[m].replace("{state}", state), intent=f"interest.list.{m}.{state}", paging=("start", MARK_STEP, 0)) for m in media for state in MARK_STATES[m]]
    if catalog:
        rows += [_route("interest.item", CATALOG, kind="catalog", ordered=False, requires=AFTER_TIMELINE), _route("asset.subject_cover", CATALOG + 1, intent="asset.image.catalog_thumbnail", kind="catalog", surface="asset", ordered=False, requires=AFTER_TIMELINE)]
    return rows


def route_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(default_routes() if rows is None else rows, schemas.ROUTE)


def in_order(routes: DataFrame) -> DataFrame:
    """The routes with ``turn``, from 1: by priority, then key. The table is small."""
    from pyspark.sql import Window

    return routes.withColumn("turn", F.row_number().over(Window.orderBy("priority", "key")))


def entry_url(template: Column, site: str, user: str, offset: Column) -> Column:
    out = F.replace(F.replace(template, F.lit("{site}"), F.lit(site)), F.lit("{user}"), F.replace(F.url_encode(F.lit(user)), F.lit("+"), F.lit("%20")))
    return F.replace(out, F.lit("{offset}"), offset.cast("string"))


def seed_frontier(routes: DataFrame, site: str, user: str) -> DataFrame:
    """The queue that a run starts with: the entry page of each route that waits for no other, once for each URL key. Routes with pages are ordered unless they say otherwise."""
    first = F.coalesce("pagination.first", F.lit(0))
    ready = routes.where((F.size(F.coalesce("requires", F.array())) == 0) & F.col("template").isNotNull())
    rows = ready.select(
        entry_url(F.col("template"), site, user, first).alias("url"), F.col("key").alias("route_key"), "intent",
        F.when(F.col("pagination").isNotNull(), F.struct(F.col("pagination.kind").alias("kind"), F.col("pagination.first").alias("value"))).alias("cursor"),
        F.coalesce("ordered", F.col("pagination").isNotNull()).alias("ordered"), F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"), F.lit("pending").alias("state"),
    ).withColumn("url_key", url_key(F.col("url")))
    firsts = rows.groupBy("url_key").agg(F.min(F.struct("priority", "route_key")).alias("first"))
    return rows.join(firsts, "url_key").where(F.struct("priority", "route_key") == F.col("first")).drop("first")
