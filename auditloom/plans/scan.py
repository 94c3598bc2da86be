"""Whole scan: corpus to filtered, de-duplicated findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..dims import rule_packs as P
from ..session import cut_lineage
from ..operators import corpus, findings as FD, flow, rules as R, secrets

ALLOW_MARKER = "audit:allow"

# Emission order of the detector families; de-duplication keeps the earliest.
BASE = 1 << 40


INFRASTRUCTURE = ("GithubWorkflow", "Dockerfile", "ContainerManifest", "Terraform", "Config")


def detect(files: DataFrame) -> DataFrame:
    """Raw findings of every general rule family.

    All rule packs share one pass over the corpus, as do all languages of a
    flow model. Files of infrastructure kinds, a small part of any corpus, are
    written aside once for the families that only read those.
    """
    infra = cut_lineage(
        files.filter(corpus.file_kind(F.col("path")).isin(*INFRASTRUCTURE)).select("repo", "path", "source"), "infra"
    )
    creds = secrets.secret_scan(files).select(
        "repo", "file", "line", "invariant_id",
        F.when(F.col("invariant_id") == "gen_private_key_committed", "Critical").otherwise("High").alias("severity"),
        F.lit("Credential committed to the repository").alias("message"), "snippet",
        F.lit(0).cast("long").alias("ord"),
    )
    actions = R.unpinned_actions(infra).select(
        "repo", F.col("path").alias("file"), "line", F.lit("gen_ci_unpinned_action").alias("invariant_id"),
        F.lit("Low").alias("severity"),
        F.concat(F.lit("Third-party action `"), "action", F.lit("` is pinned to mutable ref `"), "ref", F.lit("`")).alias("message"),
        F.concat_ws("@", "action", "ref").alias("snippet"), F.lit(0).cast("long").alias("ord"),
    )
    families = [
        creds, flow.value_flow(files), flow.model_output_flow(files), R.scan_files(files, P.ALL_PACKS),
        R.restrict_to_indented_block(infra, P.RUN_BLOCK_OPENER, P.CI_RUN_PACK),
        actions, R.docker_base_and_user(infra), R.open_ingress(infra, "Terraform"),
        R.open_ingress(infra, "CloudFormation"), R.check_then_use(files), R.repo_absence(files, P.REPO_RULES),
    ]
    return FD.union_findings(*[
        f.withColumn("ord", F.col("ord") + i * BASE) for i, f in enumerate(families)
    ]).withColumns({"col": F.lit(0).cast("long"), "evidence": F.lit("lead")})


def scan(files: DataFrame, minimum: str = "low", needles: Sequence[str] = (), marker: str = ALLOW_MARKER) -> DataFrame:
    """detect, suppress, restore, redact, de-duplicate, filter."""
    raw = detect(files)
    # Only files that carry a marker or a finding have their lines joined.
    lines = corpus.explode_lines(files.filter(F.contains(F.col("source"), F.lit(marker))))
    kept = FD.suppress(raw, lines, marker)
    unique = secrets.redact(FD.dedup_findings(kept))
    out = FD.filter_min_severity(unique, minimum)
    return FD.filter_rule(out, needles) if needles else out
