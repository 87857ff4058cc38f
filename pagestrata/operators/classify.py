"""Verdicts on responses: an ordered rule list as one CASE, so it stays in generated code and reads its own reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions.text import looks_like_image
from pagestrata.functions.urls import host_of

# fixed values: verdicts, what each does to a queue item, and the pauses after which work may go on
VERDICTS = ("ok", "blocked", "challenge", "login", "gone", "soft404", "unknown")
TRANSITIONS = (
    ("ok", "done", False, None),
    ("gone", "done", False, None),
    ("soft404", "done", False, None),
    ("blocked", "awaiting_human", False, "blocked"),
    ("challenge", "awaiting_human", False, "challenge"),
    ("login", "terminal_stop", True, "session_expired"),
    ("unknown", "failed", False, "unclassified"),
)
AUTO_RESUME = ("crash", "network_down")
NO_AUTO_RESUME = ("user_paused", "challenge", "blocked", "session_expired", "account_switched", "host_permission_lost", "failures_pending", "quota", "write_failed", "finalize_failed", "driver_stalled")
QUIET = ("crash", "network_down")


@dataclass(frozen=True)
class Markers:
    """Patterns of the site's own pages."""

    security_host: str = "sec.example.com"
    login_title: str = r"<title>\s*Sign in\s*</title>"
    not_found: str = "Page not found"
    captcha: str = "(?i)captcha"
    abnormal: str = "unusual requests|too many requests"


@dataclass(frozen=True)
class Profile:
    """What pages of one route look like. ``any_frames``: one is enough; ``frames``: all are needed."""

    url_anchor: str | None = None
    any_frames: tuple[str, ...] = ()
    frames: tuple[str, ...] = ()
    item_anchor: str | None = None
    user_nav: str = r"nav-user-account|/accounts/logout"


GENERIC = Profile(frames=("<html", "<title>"), item_anchor="<li>", user_nav="<html")


def _rules(u: Column, s: Column, b: Column, profile: Profile, markers: Markers) -> list[tuple[Column, str, str | None, str]]:
    """(holds, verdict, reason, text) in order; where none holds, the verdict is ok."""
    host = F.regexp_replace(host_of(u), ":[0-9]*$", "")
    secured = (host == markers.security_host) | F.endswith(host, F.lit(f".{markers.security_host}"))
    captcha, abnormal = b.rlike(markers.captcha), b.rlike(markers.abnormal)
    drifted = ~u.rlike(profile.url_anchor) if profile.url_anchor else F.lit(False)
    if profile.any_frames:
        frameless = ~F.greatest(*(b.rlike(x) for x in profile.any_frames), F.lit(False))
    else:
        frameless = ~F.least(*(b.rlike(x) for x in profile.frames), F.lit(True), F.lit(True))
    return [
        (b.isNull() | (b == ""), "unknown", "empty_body", "empty body"),
        (F.coalesce(host, F.lit("")) == "", "unknown", "malformed_url", "the final URL can't be read"),
        (secured & captcha, "challenge", None, "sent to the security host"),
        (secured, "blocked", None, "sent to the security host"),
        (b.rlike(markers.login_title), "login", None, "the title is the sign-in page's"),
        (s == 404, "gone", None, "HTTP 404"),
        (s.isin(403, 429, 418), "blocked", None, "HTTP 403, 429 or 418"),
        (s >= 500, "unknown", "server_error", "server error"),
        (s.isNull() | (s != 200), "unknown", "unexpected_status", "unexpected status"),
        (abnormal & captcha, "challenge", None, "the page speaks of unusual requests"),
        (abnormal, "blocked", None, "the page speaks of unusual requests"),
        (b.rlike(markers.not_found), "soft404", None, "the page says it wasn't found"),
        (~b.rlike(profile.user_nav), "login", None, "no signed-in user in the navigation"),
        (drifted, "unknown", "url_drifted", "the final URL isn't this route's"),
        (frameless, "unknown", "frame_anchors_missing", "the page's frame is missing"),
    ]


def _first(rules: list[tuple]) -> Column:
    """The number of the first rule that holds, one past the last if none does. As a column of its own it is worked out once a row."""
    arms = None
    for k, rule in enumerate(rules):
        arms = F.when(rule[0], k) if arms is None else arms.when(rule[0], k)
    return arms.otherwise(len(rules))


def _told(rules: list[tuple], number: Column, pick: int, otherwise: str | None) -> Column:
    """What the rule of that number says."""
    return F.get(F.array(*(F.lit(r[pick]).cast("string") for r in rules), F.lit(otherwise).cast("string")), number)


def classify(pages: DataFrame, profile: Profile = GENERIC, markers: Markers = Markers(), url: str = "final_url", status: str = "status", body: str = "body") -> DataFrame:
    """The rows with ``verdict`` (unknown where no rule tells), ``verdict_reason`` (only then), ``reasons`` and ``item_count``. The first rule that holds wins; an empty body outranks all."""
    b = F.col(body)
    rules = _rules(F.col(url), F.col(status), b, profile, markers)
    count = F.regexp_count(b, F.lit(profile.item_anchor)) if profile.item_anchor else F.lit(None).cast("int")
    numbered = pages.withColumns({"rule_no": _first(rules), "item_count": count})
    number = F.col("rule_no")
    empty = F.when(F.coalesce("item_count", F.lit(-1)) == 0, F.lit("no items"))
    passed = F.array_compact(F.array(F.lit("signed in"), F.when(F.lit(bool(profile.url_anchor)), F.lit("the URL is still this route's")), F.lit("frame complete"), empty))
    reasons = F.when(number < len(rules), F.array(_told(rules, number, 3, None))).otherwise(passed)
    out = numbered.withColumns({"verdict": _told(rules, number, 1, "ok"), "verdict_reason": _told(rules, number, 2, None), "reasons": reasons})
    return out.select(*pages.columns, "verdict", "verdict_reason", "reasons", "item_count")


def classify_asset(assets: DataFrame, markers: Markers = Markers(), url: str = "final_url", status: str = "status", content_type: str = "content_type", body: str = "content") -> DataFrame:
    """``verdict`` and ``verdict_reason`` of an image response: HTML is judged as a page but never ok, and bytes outrank a wrong content type."""
    s, data = F.col(status), F.col(body)
    kind = F.lower(F.trim(F.substring_index(F.coalesce(F.col(content_type), F.lit("")), ";", 1)))
    html = F.startswith(kind, F.lit("text/html"))
    page = _rules(F.col(url), s, data.cast("string"), Profile(), markers)
    own = [
        (s.isin(403, 418), "blocked", None), (s == 404, "gone", None), (F.coalesce(s != 200, F.lit(True)), "unknown", "unexpected_status"),
        (F.coalesce(F.octet_length(data), F.lit(0)) == 0, "unknown", "empty_body"), (~(F.startswith(kind, F.lit("image/")) | looks_like_image(data)), "unknown", "not_an_image"),
    ]
    numbered = assets.withColumns({"is_html": html, "rule_no": F.when(html, _first(page)).otherwise(_first(own))})
    number = F.col("rule_no")
    verdict = F.when(F.col("is_html"), _told(page, number, 1, "unknown")).otherwise(_told(own, number, 1, "ok"))
    reason = F.when(F.col("is_html"), _told(page, number, 2, "html_for_image")).otherwise(_told(own, number, 2, None))
    return numbered.withColumns({"verdict": verdict, "verdict_reason": reason}).select(*assets.columns, "verdict", "verdict_reason")


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "verdict string, state string, stop_run boolean, transition_reason string")


def with_transition(rows: DataFrame) -> DataFrame:
    """Each row's next queue state by its verdict; a verdict that isn't known counts as failed."""
    table = F.broadcast(transition_table(rows.sparkSession))  # one row a verdict
    out = rows.join(table, "verdict", "left")
    known = F.col("state").isNotNull()
    return out.withColumns({"state": F.coalesce("state", F.lit("failed")), "stop_run": F.coalesce("stop_run", F.lit(False)), "retryable": F.lit(False), "transition_reason": F.when(known, F.col("transition_reason")).otherwise(F.lit("unknown_verdict"))})


def decide_resume(checkpoints: DataFrame, now_ms: Column, pause: str = "pause_reason", level: str = "backoff_level", paused_at: str = "paused_at_ms") -> DataFrame:
    """``resume``, ``user_visible`` and ``cooldown_ms``: only quiet pauses go on by themselves, after their wait; an unknown pause never does."""
    from pagestrata.functions.times import required_cooldown_ms

    p = F.col(pause)
    auto = F.coalesce(p.isin(*AUTO_RESUME), F.lit(False))
    wait = F.when(auto, required_cooldown_ms(F.col(level), F.col(paused_at), now_ms)).otherwise(F.lit(0)).cast("long")
    return checkpoints.withColumns({"resume": auto & (wait <= 0), "user_visible": ~auto, "known_pause": F.coalesce(p.isin(*AUTO_RESUME, *NO_AUTO_RESUME), F.lit(False)), "cooldown_ms": wait})


def same_account(user_id: Column, username: Column, want_id: str | None, want_name: str | None) -> Column:
    """A criterion that isn't given doesn't count; an unknown value never matches a given one."""
    ok = F.lit(True)
    if want_id is not None:
        ok = ok & F.coalesce(user_id == want_id, F.lit(False))
    if want_name is not None:
        ok = ok & F.coalesce(username == want_name, F.lit(False))
    return ok


def first_hint(body: Column, patterns: Sequence[str]) -> Column:
    """The first group of the first pattern that matches."""
    return F.coalesce(*(F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in patterns))
