"""Lockfiles to one package table, natively except for recursive npm v1 trees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as TX, versions as V

# Folders that hold other people's lockfiles.
SKIPPED = r"(^|/)(node_modules|target|\.git|vendor|\.venv|venv|dist|build|\.next|__pycache__)/"

_ENTRY = "struct<version:string,resolved:string,integrity:string,link:boolean,hasInstallScript:boolean>"
NPM_LOCK = f"struct<packages:map<string,{_ENTRY}>,dependencies:map<string,string>>"
PIPFILE_LOCK = "struct<default:map<string,struct<version:string>>,develop:map<string,struct<version:string>>>"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def npm_package_name(key: Column) -> Column:
    """The package a node_modules key installs."""
    return F.substring_index(key, "node_modules/", -1)


def npm_entries(files: DataFrame) -> DataFrame:
    """Entries of npm lockfiles (v2/v3), the root entry excluded; of files, or of what :func:`parsed_lockfiles` gives."""
    if "npm" not in files.columns:
        locks = files.filter(file_name(F.col("path")).isin("package-lock.json", "npm-shrinkwrap.json"))
        files = locks.select("repo", "path", F.map_entries(F.from_json("source", NPM_LOCK)["packages"]).alias("npm"))
    return files.select("repo", "path", F.explode("npm").alias("e")).filter(F.col("e.key") != "").select(
        "repo", "path", "e.key", npm_package_name(F.col("e.key")).alias("name"), "e.value.*"
    )


_PACKAGE = "array<struct<name:string,version:string>>"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])))
def _v1_tree(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Flatten the nested ``dependencies`` of npm v1 lockfiles; null for null and for what is no tree."""
    import json

    def flatten(source: str | None) -> list[dict] | None:
        if source is None:
            return None
        try:
            tree = json.loads(source)
        except (ValueError, RecursionError):
            return None
        out, todo = [], [tree.get("dependencies") if isinstance(tree, dict) else None]
        while todo:
            branch = todo.pop()
            for name, entry in branch.items() if isinstance(branch, dict) else ():
                if isinstance(entry, dict):
                    if isinstance(entry.get("version"), str):
                        out.append({"name": name, "version": entry["version"]})
                    todo.append(entry.get("dependencies"))
        return out

    for batch in sources:
        yield batch.map(flatten, na_action=None)


def _pairs(source: Column, pattern: str) -> Column:
    """(name, version) of every match of a pattern with these two groups."""
    names, versions = (F.regexp_extract_all(source, F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.arrays_zip(names.alias("name"), versions.alias("version"))


def _package(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def parse_lockfiles(files: DataFrame) -> DataFrame:
    """One row per lockfile: repo, path, ecosystem, packages (name, version as written) and reason."""
    return parsed_lockfiles(files).filter("not skipped").drop("skipped", "npm")


def parsed_lockfiles(files: DataFrame) -> DataFrame:
    """The rows of :func:`parse_lockfiles`, with ``skipped`` ones of other people's folders, and ``npm``: the entries of an npm lockfile as they are.

    One pass: every file picks its parser by its name, and only that one runs. Only the nested trees of npm's first format go
    through Python; other rows hand it null. ``reason`` says why a file could not be read: `not JSON`, or `no
    lockfile` for JSON of another shape. Such files have no packages and stop nothing.
    """
    scoped = files.select("repo", "path", "source", F.col("path").rlike(SKIPPED).alias("skipped"), file_name(F.col("path")).alias("_name"))
    src, name = F.col("source"), F.col("_name")
    npm = name.isin("package-lock.json", "npm-shrinkwrap.json")
    is_json = npm | (name == "Pipfile.lock")
    known = is_json | name.isin("Cargo.lock", "poetry.lock", "yarn.lock", "go.sum") | name.rlike(r"^requirements.*\.txt$")
    valid = F.col("_valid")
    old = npm & F.try_variant_get(valid, "$.packages", "variant").isNull() & F.try_variant_get(valid, "$.dependencies", "variant").isNotNull()
    rows = scoped.filter(known).withColumn("_valid", TX.once(F.try_parse_json(F.when(is_json, src))))
    rows = rows.select("*", valid.isNotNull().alias("_json"), F.coalesce(old, F.lit(False)).alias("_old")).drop("_valid")
    rows = rows.withColumn("_tree", _v1_tree(F.when(F.col("_old"), src)))
    # JSON that is not strictly such has no packages, but what can be read of its entries counts.
    rows = rows.withColumn("_all", F.from_json(F.when(npm, src), NPM_LOCK)["packages"])
    rows = rows.withColumn("_npm", F.when(F.col("_json"), F.col("_all"))).withColumn("_pip", F.from_json(F.when((name == "Pipfile.lock") & F.col("_json"), src), PIPFILE_LOCK))

    entries = F.filter(F.map_entries("_npm"), lambda e: (e["key"] != "") & e["value"]["version"].isNotNull())
    npm_rows = F.transform(entries, lambda e: _package(npm_package_name(e["key"]), e["value"]["version"]))
    block = r'\[\[package\]\]\nname = "([^"]+)"\nversion = "([^"]+)"'
    header, pinned = r'(?m)^"?(@?[^@"\n#]+)@[^\n]*:$', r'\n\s+version[\s:]+"?([^"\n]+)"?'
    yarn = F.transform(
        F.filter(F.split(src, r"\n\s*\n"), lambda b: b.rlike(header) & b.rlike(pinned)),
        lambda b: _package(F.trim(F.regexp_extract(b, header, 1)), F.trim(F.regexp_extract(b, pinned, 1))),
    )
    none = F.array().cast(_PACKAGE)
    pip = F.concat(*[
        F.coalesce(F.transform(
            F.filter(F.map_entries(F.col("_pip")[s]), lambda e: e["value"]["version"].isNotNull()),
            lambda e: _package(e["key"], F.regexp_replace(e["value"]["version"], "^(==)+", "")),
        ), none) for s in ("default", "develop")
    ])
    req = r"^\s*([A-Za-z0-9_.\-\[\]]+)\s*==\s*([A-Za-z0-9_.+!\-]+)"
    required = F.transform(
        F.filter(F.transform(F.split(src, r"\r?\n"), lambda x: F.trim(F.substring_index(x, "#", 1))), lambda x: x.rlike(req)),
        lambda x: _package(F.substring_index(F.regexp_extract(x, req, 1), "[", 1), F.regexp_extract(x, req, 2)),
    )
    packages = (
        F.when(npm, F.when(F.col("_old"), F.col("_tree")).otherwise(npm_rows)).when(name.isin("Cargo.lock", "poetry.lock"), _pairs(src, block))
        .when(name == "yarn.lock", yarn).when(name == "Pipfile.lock", pip)
        # The "/go.mod" line repeats the module line and is not matched.
        .when(name == "go.sum", _pairs(src, r"(?m)^(\S+)\s+v([^\s/]+)\s+h1:")).otherwise(required)
    )
    ecosystem = F.when(npm | (name == "yarn.lock"), "npm").when(name == "Cargo.lock", "crates.io").when(name == "go.sum", "Go").otherwise("PyPI")
    shaped = F.when(npm, F.coalesce(F.col("_npm").isNotNull() | (F.col("_tree").isNotNull()), F.lit(False))).otherwise(F.col("_pip").isNotNull())
    reason = F.when(is_json & ~F.col("_json"), "not JSON").when(is_json & ~shaped, "no lockfile")
    return rows.select("repo", "path", ecosystem.alias("ecosystem"), F.coalesce(packages, none).alias("packages"), reason.alias("reason"), "skipped", F.map_entries("_all").alias("npm"))


def read_lockfiles(files: DataFrame) -> DataFrame:
    """packages(repo, ecosystem, name, version, source_file) from every known format; the files are read once."""
    return packages_of(parse_lockfiles(files))


def packages_of(parsed: DataFrame) -> DataFrame:
    """:func:`read_lockfiles` of the rows of :func:`parse_lockfiles`."""
    rows = parsed.select("repo", "path", "ecosystem", F.inline("packages"))
    return rows.select(
        "repo", "ecosystem",
        V.normalize_package_name(F.col("ecosystem"), F.col("name")).alias("name"),
        F.trim("version").alias("version"), F.col("path").alias("source_file"),
    )


def rejected_lockfiles(files: DataFrame) -> DataFrame:
    """(repo, path, reason) of the lockfiles that could not be read."""
    return parse_lockfiles(files).filter("reason is not null").select("repo", "path", "reason")
