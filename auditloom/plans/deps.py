"""Dependency check: lockfiles and advisories to findings and a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import findings as FD, sca
from ..session import cut_lineage
from ..sources.lockfiles import file_name, npm_entries, packages_of, parsed_lockfiles


def _as_findings(df: DataFrame, rule: str | Column, severity: str | Column, file: str, message: Column, line=1) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "repo", lit(rule).alias("invariant_id"), lit(severity).alias("severity"), F.col(file).alias("file"),
        (F.col(line) if isinstance(line, str) else F.lit(line)).cast("long").alias("line"),
        F.lit(0).cast("long").alias("col"), message.alias("message"), message.alias("snippet"),
        F.lit("lead").alias("evidence"), F.lit(0).cast("long").alias("ord"),
    )


def dependency_findings(files: DataFrame, advisories: DataFrame) -> DataFrame:
    # The corpus is read once: what dependency checks look at is a small part of it.
    name = file_name(F.col("path"))
    looked_at = name.isin(*sca.MANIFESTS, *{l for locks in sca.MANIFESTS.values() for l in locks}, "npm-shrinkwrap.json", ".npmrc", "pip.conf", "pip.ini")
    files = cut_lineage(files.filter(looked_at | name.rlike(r"^requirements.*\.txt$") | name.isin("Cargo.lock", "poetry.lock", "Pipfile.lock", "go.sum")), "manifests")
    # Lockfiles are parsed once, also for the three checks that look at the entries of npm lockfiles; advisories and look-alike names both read the packages.
    parsed = cut_lineage(parsed_lockfiles(files), "lockfiles")
    packages = cut_lineage(packages_of(parsed.filter("not skipped")), "packages")
    vulnerable = sca.vulnerable_packages(packages, advisories)
    manifests = sca.npm_manifest_deps(files)
    entries = npm_entries(parsed)
    locked = entries.select("repo", sca.folder(F.col("path")).alias("dir"), "name", "resolved")
    rc = files.filter(F.col("path").rlike(r"(^|/)\.npmrc$")).select("repo", sca.folder(F.col("path")).alias("dir"), "source")
    scopes = sca.unmapped_scopes(manifests, locked, rc).withColumn("file", F.concat("dir", F.lit("package.json")))
    return FD.union_findings(
        _as_findings(vulnerable, F.col("invariant_id"), F.col("severity"), "source_file", F.concat_ws(" ", "purl", "advisory")),
        _as_findings(sca.missing_integrity(files, entries), "sca_lockfile_missing_integrity", "Medium", "path",
                     F.concat(F.col("missing").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" entries without a hash"))),
        _as_findings(sca.install_scripts(files, entries), "sca_install_script_dependency", "Info", "file", F.col("package")),
        _as_findings(sca.missing_lockfile(files), "sca_missing_lockfile", "Medium", "file", F.col("manifest")),
        _as_findings(sca.unpinned_requirements(files), "sca_unpinned_dependency", "Low", "file", F.col("requirement"), "line"),
        _as_findings(sca.extra_index(files), "sca_dependency_confusion", "High", "file", F.col("snippet"), "line"),
        _as_findings(scopes, "sca_dependency_confusion", "Low", "file", F.concat(F.lit("@"), F.col("scope"))),
        _as_findings(sca.typosquats(packages), "sca_typosquat_candidate", "Low", "source_file", F.concat_ws(" looks like ", "name", "target")),
    )


def deps(files: DataFrame, advisories: DataFrame, fail_on: str = "high") -> tuple[DataFrame, DataFrame]:
    """(findings, gate per repository)."""
    found = dependency_findings(files, advisories)
    return found, FD.gate(found, fail_on, leads=True)
