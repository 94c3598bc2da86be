"""Whole plans: scan, release check, dependency check, and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import findings as FD, risk as RK, secrets
from ..plans import deps as DP, release_check as RC, scan as SC
from . import base as B
from .base import q, query, with_ctes
from .q_risk import EXPO
from .q_rules import SECRET_ROWS
from .q_sca import advisories, manifest_files, npm_locks


@query("plan_secret_exposure", with_ctes(B.FILES, B.LINES, SECRET_ROWS, EXPO, body="""
, u AS (SELECT repo, invariant_id, path, line FROM secret GROUP BY ALL),
r AS (SELECT u.*, CASE vector WHEN 'network' THEN 3 WHEN 'adjacent' THEN 2 ELSE 1 END - CASE prereq WHEN 'none' THEN 0 WHEN 'privileged' THEN 2 ELSE 1 END - CASE interaction WHEN 'required' THEN 1 ELSE 0 END AS s FROM u JOIN expo USING (invariant_id))
SELECT repo, CASE WHEN s >= 3 THEN 'LIKELY' WHEN s = 2 THEN 'POSSIBLE' WHEN s = 1 THEN 'UNLIKELY' ELSE 'THEORETICAL' END AS exploitability, count(*) FILTER (WHERE invariant_id = 'gen_private_key_committed') AS critical, count(*) FILTER (WHERE invariant_id = 'gen_hardcoded_secret') AS high, count(*) AS total FROM r GROUP BY ALL"""))
def plan_secret_exposure(spark, sf):
    """Files to credentials to de-duplicated, rated severity counts per repository."""
    found = secrets.redact(secrets.secret_scan(B.files(spark, sf), skip_docs=False)).withColumns({
        "severity": F.when(F.col("invariant_id") == "gen_private_key_committed", "Critical").otherwise("High"),
        "ord": F.col("line"), "evidence": F.lit("lead"),
    })
    unique = FD.dedup_findings(found.drop("value"))
    rated = RK.rate(unique, RK.exposure_table(spark))
    return FD.severity_stats(rated, ["repo", "exploitability"]).select("repo", "exploitability", "critical", "high", "total")


@query("plan_scan")
def plan_scan(spark, sf):
    return SC.scan(B.code_files(spark, sf), "low").select("repo", "file", "line", "invariant_id", "severity", "snippet")


@query("plan_scan_summary")
def plan_scan_summary(spark, sf):
    """A whole scan, rated and counted per repository and exploitability."""
    found = SC.scan(B.code_files(spark, sf), "low")
    return FD.severity_stats(RK.rate(found, RK.exposure_table(spark)), ["repo", "exploitability"])


@query("plan_release_check")
def plan_release_check(spark, sf):
    files = B.code_files(spark, sf)
    none = spark.createDataFrame([], "pos bigint, id string, path string, `match` string, reason string, owner string, until string")
    return RC.release_check(files, SC.scan(files), none, "2024-01-15").items


@query("plan_deps")
def plan_deps(spark, sf):
    files = manifest_files(spark, sf).unionByName(npm_locks(spark, sf))
    found, _ = DP.deps(files, advisories(spark, sf))
    return found.select("repo", "file", "line", "invariant_id", "severity", "message")


@query("plan_deps_gate")
def plan_deps_gate(spark, sf):
    files = manifest_files(spark, sf).unionByName(npm_locks(spark, sf))
    return DP.deps(files, advisories(spark, sf))[1]
