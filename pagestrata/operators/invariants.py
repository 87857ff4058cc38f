"""Data-quality rules of index rows and manifests: which rules each row breaks, and the split into good and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.digests import EMPTY_SHA256
from pagestrata.functions.times import has_offset
from pagestrata.operators.classify import VERDICTS

# fixed values: closed vocabularies of the index and the manifest
SURFACES = ("html", "api", "asset")
FIDELITIES = ("raw", "decoded_body+observed_headers", "decoded_body+filtered_headers")
REQUIRED = ("capture_id", "warc_record_id", "segment", "offset", "length", "url", "intent", "route_key", "surface", "verdict", "capture_fidelity", "observed_at")
STATUSES = ("in_progress", "complete", "aborted")
CLAIMS = ("completeness", "reconciled", "complete", "is_complete")


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that don't hold; a rule that can't be told doesn't."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def index_rules(rows: DataFrame) -> DataFrame:
    """``broken``: rules of index rows that don't hold. A required field that is null breaks a rule of its own; one that isn't null may still break the rule on its values."""
    c = F.col
    given = lambda name, ok: c(name).isNull() | ok
    return rows.withColumn("broken", _broken({
        **{f"missing_{name}": c(name).isNotNull() for name in REQUIRED},
        "offset": given("offset", c("offset") >= 0),
        "length": given("length", c("length") >= 1),
        "verdict": given("verdict", c("verdict").isin(*VERDICTS)),
        "surface": given("surface", c("surface").isin(*SURFACES)),
        "capture_fidelity": given("capture_fidelity", c("capture_fidelity").isin(*FIDELITIES)),
        "observed_at": given("observed_at", has_offset(c("observed_at"))),
        "empty_not_ok": F.coalesce(c("content_sha256") != EMPTY_SHA256, F.lit(True)) | (c("verdict") != "ok"),
        "reason_only_unknown": c("verdict_reason").isNull() | (c("verdict") == "unknown"),
    }))


def state_rules(rows: DataFrame) -> DataFrame:
    """``broken``: rules of crawl state and coverage rows that don't hold."""
    c = F.col
    return rows.withColumn("broken", _broken({
        "claim_has_source": c("claimed_count").isNull() | c("claimed_source").isNotNull(),
        "floor_is_bounded": c("floor_time").isNull() | (c("enumeration") != "full"),
        "advanced_is_clean": ~c("advanced") | (c("contiguous") & (F.size("gaps") == 0) & c("high_water_time").isNotNull()),
        "times_have_offset": (c("high_water_time").isNull() | has_offset(c("high_water_time"))) & (c("floor_time").isNull() | has_offset(c("floor_time"))),
    }))


def manifest_rules(rows: DataFrame) -> DataFrame:
    """``broken``: the status is known, and a complete manifest says when, with an offset."""
    c = F.col
    return rows.withColumn("broken", _broken({"status": c("status").isin(*STATUSES), "completed_at": (c("status") != "complete") | has_offset(c("completed_at"))}))


def claims_completeness(field_names: list[str]) -> list[str]:
    """Fields that a coverage entry must not have: counts never prove completeness."""
    return [f for f in field_names if f in CLAIMS]


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others."""
    return rows.where(F.size("broken") == 0).drop("broken"), rows.where(F.size("broken") > 0)
