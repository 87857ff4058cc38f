"""URL keys, cursors and small URL predicates as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_RULES = "v1"
# fixed values: query parameters that only track, by exact name
TRACKING_PARAMS = ("_spm_id", "_dtcc", "_i", "dcs", "dcm", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ck")


def is_tracking_param(name: Column) -> Column:
    return name.isin(*TRACKING_PARAMS)


# fixed values: characters that a path keeps besides letters, digits and what form encoding keeps; the percent sign is last, as it brings the others back
PATH_KEEPS = "/!$&'()+,:;=@[\\]|~^%"


def _form_decoded(text: Column) -> Column:
    """As forms are decoded: a plus is a space, and a percent sign that starts no code stays."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _path_encoded(path: Column) -> Column:
    """Spaces, quotes, angle brackets, braces, backquotes and all beyond ASCII as percent codes; codes that are there stay."""
    out = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for char in PATH_KEEPS:
        out = F.replace(out, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return F.when(path.rlike("[^!$-;=?-_a-z|~]"), out).otherwise(path)


def _no_dots(path: Column) -> Column:
    """Without ``.`` and ``..`` segments, each of which stands for a directory."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    last = F.element_at(parts, -1)
    up = lambda x: F.lower(x).isin("..", ".%2e", "%2e.", "%2e%2e")
    here = lambda x: F.lower(x).isin(".", "%2e")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, x: F.when(here(x), a).when(up(x), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    kept = F.when(here(last) | up(last), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike("(?i)/([.]|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def url_key(url: Column, tracking: Sequence[str] = TRACKING_PARAMS) -> Column:
    """The URL with lower-case scheme and host, no fragment, no tracking parameters, and parameters sorted by name (stably).

    Parameters are decoded and encoded again the way forms are (a space becomes ``+``), so equal ones have one spelling. Path case and
    trailing slashes stay; an empty path becomes ``/``, dot segments and a scheme's default port go, and characters that a path can't
    hold are encoded. Text that isn't an absolute URL gives null. Names are compared as UTF-8.
    """
    plain = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\r\\n]", "")
    whole = F.regexp_replace(plain, "#[\\s\\S]*$", "")
    bare = F.substring_index(whole, "?", 1)
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    user = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*@)", 1)
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/]*@)?([^/@]+)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(host)
    path = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]+(/[\\s\\S]*)$", 1)
    path = F.when(path == "", "/").otherwise(_path_encoded(_no_dots(path)))
    query = F.when(F.instr(whole, "?") > 0, F.substr(whole, F.instr(whole, "?") + 1)).otherwise("")
    cut = lambda kv: F.when(F.instr(kv, "=") > 0, F.substr(kv, F.instr(kv, "=") + 1)).otherwise("")
    parts = F.transform(F.filter(F.split(query, "&"), lambda kv: kv != ""), lambda kv, i: F.struct(_form_decoded(F.substring_index(kv, "=", 1)).alias("name"), i.alias("at"), _form_decoded(cut(kv)).alias("value")))
    kept = F.array_sort(F.filter(parts, lambda p: ~p["name"].isin(*tracking)))
    tail = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    key = F.concat(scheme, F.lit("://"), user, host, path, F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))
    return F.when((scheme != "") & (host != ""), key)


def query_param(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def cursor_from_url(url: Column, param: str, first: int) -> Column:
    """The paging number in the URL; the first page's if the parameter is missing, null if it isn't a number."""
    raw = query_param(url, param)
    return F.when(raw.isNull(), F.lit(first).cast("long")).otherwise(raw.try_cast("long"))


def with_token(url: Column, name: str, token: str) -> Column:
    """Add a parameter unless the URL has it."""
    return F.when(url.rlike(f"[?&]{name}="), url).otherwise(F.concat(url, F.when(F.instr(url, "?") > 0, "&").otherwise("?"), F.lit(f"{name}={token}")))


def is_shortlink(url: Column, hosts: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts), F.lit(False))


def host_of(url: Column) -> Column:
    """The lower-case host with its port, without a user."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1))
