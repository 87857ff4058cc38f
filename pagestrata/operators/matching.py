"""Set questions across snapshots: seen before, still missing, same on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: files that don't count when two copies are compared
NOT_PART = ("checkpoint.json", "README.txt")


def frontier_dedup(candidates: DataFrame, captured: DataFrame, key: str = "url_key") -> DataFrame:
    """The first candidate of each key that isn't captured yet."""
    fresh = candidates.join(captured.select(key).distinct(), key, "left_anti")
    firsts = fresh.groupBy(key).agg(F.min("seq").alias("seq"))
    return fresh.join(firsts, [key, "seq"], "left_semi")


def repeated_captures(newer: DataFrame, older: DataFrame, key: str = "url_key") -> DataFrame:
    """Newer captures of pages that older snapshots have too."""
    return newer.join(older.select(key), key, "left_semi")


def backlog(derived: DataFrame, captured: DataFrame, key: str = "url_key") -> DataFrame:
    """Derived URLs without capture, each once, with how often and where first they were found."""
    rows = derived.groupBy(key).agg(F.count("*").alias("times"), F.min("seq").alias("first_seq"))
    return rows.join(captured.select(key), key, "left_anti")


def coverage_report(coverage: DataFrame, state: DataFrame) -> DataFrame:
    """Coverage with what the crawl state says of it: verified, in_progress, gaps or unfinished."""
    both = coverage.join(state, ["bundle_id", "route_key"], "left")
    n = F.coalesce(F.col("n_gaps"), F.lit(0))
    label = F.when(F.col("contiguous"), "verified").when(F.col("finished").isNull(), "in_progress").when(n > 0, "gaps").otherwise("unfinished")
    return both.withColumn("label", label).withColumn("n_gaps", n)


def compare_contents(source: DataFrame, target: DataFrame) -> DataFrame:
    """same, partial (files are missing in the target) or different (extra or other files), by bundle in the target."""
    keep = ~F.col("name").isin(*NOT_PART)
    s = source.where(keep).select("bundle_id", "name", F.col("bytes").alias("source_bytes"))
    t = target.where(keep).select("bundle_id", "name", F.col("bytes").alias("target_bytes"))
    both = s.join(t, ["bundle_id", "name"], "full")
    other = F.col("target_bytes").isNotNull() & ~F.col("source_bytes").eqNullSafe(F.col("target_bytes"))
    counts = both.groupBy("bundle_id").agg(F.max(other).alias("other"), F.max(F.col("target_bytes").isNull()).alias("missing"), F.count("target_bytes").alias("present"))
    return counts.where("present > 0").select("bundle_id", F.when(F.col("other"), "different").when(F.col("missing"), "partial").otherwise("same").alias("relation"))


def copy_verify(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Each file's state in the copy: verified (size and digest), size_only, missing, size_mismatch, digest_mismatch, extra."""
    s = source.select("name", F.col("bytes").alias("s_bytes"), F.col("sha256").alias("s_sha"))
    c = copy.select("name", F.col("bytes").alias("c_bytes"), F.col("sha256").alias("c_sha"))
    status = (
        F.when(F.col("c_bytes").isNull(), "missing").when(F.col("s_bytes").isNull(), "extra").when(F.col("s_bytes") != F.col("c_bytes"), "size_mismatch")
        .when(F.col("s_sha").isNull() | F.col("c_sha").isNull(), "size_only").when(F.col("s_sha") != F.col("c_sha"), "digest_mismatch").otherwise("verified")
    )
    return s.join(c, "name", "full").select("name", status.alias("status"))


def missing_predecessors(bundles: DataFrame) -> DataFrame:
    """Bundles whose predecessor isn't there."""
    known = bundles.select(F.col("bundle_id").alias("previous_bundle_id"))
    return bundles.where("previous_bundle_id is not null").join(known, "previous_bundle_id", "left_anti")


def declared_files(declared: DataFrame, files: DataFrame) -> DataFrame:
    """missing_file and size_mismatch of declared files, undeclared_file of others."""
    from pagestrata.operators.rollups import EXTRA_FILES

    both = declared.select("bundle_id", "name", F.col("bytes").alias("declared_bytes"), F.lit(True).alias("declared")).join(files.select("bundle_id", "name", "bytes"), ["bundle_id", "name"], "full")
    code = (
        F.when(F.col("declared") & F.col("bytes").isNull(), "missing_file").when(F.col("declared") & (F.col("bytes") != F.col("declared_bytes")), "size_mismatch")
        .when(F.col("declared").isNull() & ~F.col("name").isin(*EXTRA_FILES), "undeclared_file")
    )
    return both.select("bundle_id", "name", code.alias("code")).where("code is not null")


def plan_import(candidates: DataFrame, existing: DataFrame, relations: DataFrame, active: str | None, home: str | None) -> DataFrame:
    """What to do with each candidate (pos, bundle_id, account, fatal): refuse, active, duplicate, other_account, present, resume, conflict or import, by the first rule that holds.

    Only an import or a resume claims its id, so a later candidate of that id is a duplicate of the first claiming one.
    """
    known = existing.select("bundle_id").distinct().withColumn("here", F.lit(True))
    rows = candidates.join(known, "bundle_id", "left").join(relations, "bundle_id", "left")
    other = F.lit(False) if home is None else F.coalesce(F.col("account") != home, F.lit(False))
    blocked = F.col("fatal") | F.coalesce(F.col("bundle_id") == F.lit(active), F.lit(False))
    alone = (
        F.when(F.col("fatal"), "refuse").when(F.coalesce(F.col("bundle_id") == F.lit(active), F.lit(False)), "active").when(other, "other_account")
        .when(F.col("here") & (F.col("relation") == "same"), "present").when(F.col("here") & (F.col("relation") == "partial"), "resume").when(F.col("here"), "conflict").otherwise("import")
    )
    rows = rows.withColumn("alone", alone)
    claims = rows.where("alone in ('import', 'resume')").groupBy("bundle_id").agg(F.min("pos").alias("claimed_at"))
    rows = rows.join(claims, "bundle_id", "left")
    action = F.when(~blocked & (F.col("pos") > F.col("claimed_at")), "duplicate").otherwise(F.col("alone"))
    return rows.select("pos", "bundle_id", action.alias("action"))


def import_totals(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """How many candidates of a plan are imported or resumed, and their bytes (``sizes``: pos, bytes)."""
    going = plan.where("action in ('import', 'resume')").join(sizes.select("pos", "bytes"), "pos", "left")
    return going.groupBy("action").agg(F.count("*").alias("bundles"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def deletion_candidates(older: DataFrame, newer: DataFrame, runs: DataFrame) -> DataFrame:
    """Items of routes that a full and contiguous newer run no longer has. Not a feature of archives of partial runs."""
    whole = runs.where("enumeration = 'full' and contiguous").select("route_key")
    return older.join(whole, "route_key", "left_semi").join(newer.select("route_key", "id"), ["route_key", "id"], "left_anti")
