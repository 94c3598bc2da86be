"""Dependency risk: advisories, lockfile integrity, pinning, look-alike names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import reference as REF
from ..functions import text as TX
from ..functions import versions as V
from ..sources import lockfiles as L

COORDINATES = ["ecosystem", "name", "version"]


def distinct_packages(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*COORDINATES)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COORDINATES))
    return out.distinct()


def sorted_packages(packages: DataFrame) -> DataFrame:
    """De-duplicated and ordered by (ecosystem, name, version)."""
    return packages.select("repo", *COORDINATES).distinct().orderBy("repo", *COORDINATES)


def prepare_advisories(advisories: DataFrame) -> DataFrame:
    """Advisories with every version and requirement parsed once."""
    key = V.version_key
    return advisories.select(
        "id", "ecosystem", F.lower("name").alias("_name"), "score", "informational",
        TX.once(F.struct(
            F.transform("ranges", lambda r: F.struct(
                V.sort_key(key(r["intro"])).alias("lo"), V.sort_key(key(r["end"])).alias("hi"), r["inclusive"].alias("inclusive"),
            )).alias("ranges"),
            F.transform("versions", lambda x: V.sort_key(key(x))).alias("versions"),
            F.transform("patched", lambda r: V.requirement_clauses(r)).alias("patched"),
            F.transform("unaffected", lambda r: V.requirement_clauses(r)).alias("unaffected"),
        )).alias("spec"),
    )


def is_affected(v: Column, spec: Column) -> Column:
    """Whether a version key is hit; requirement lists, when given, replace versions and ranges."""
    sv = V.sort_key(v)
    listed = F.size(spec["patched"]) + F.size(spec["unaffected"]) > 0
    safe = F.exists(spec["patched"], lambda c: V.clauses_match(v, c)) | F.exists(
        spec["unaffected"], lambda c: V.clauses_match(v, c)
    )
    explicit = F.exists(spec["versions"], lambda x: F.coalesce(x == sv, F.lit(False)))

    def inside(r: Column) -> Column:
        below = F.when(r["inclusive"], sv <= r["hi"]).otherwise(sv < r["hi"])
        return (r["lo"].isNull() | (sv >= r["lo"])) & (r["hi"].isNull() | below)

    return F.when(listed, ~safe).otherwise(explicit | F.exists(spec["ranges"], inside))


def vulnerable_packages(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """One row per (package, advisory) whose range or lists hit the version.

    Version tests run once per distinct (ecosystem, name, version): duplicates
    of a popular package collapse on the map side before anything is compared.
    The hits then join back to all packages by equality, where a package in a
    third of all repositories is split by adaptive skew handling.
    """
    pins = packages.select("ecosystem", F.lower("name").alias("_name"), "version").distinct().withColumn(
        "v", TX.once(V.version_key(F.col("version")))
    ).filter(F.col("v").isNotNull())
    hits = (
        pins.join(prepare_advisories(advisories), ["ecosystem", "_name"])
        .filter(is_affected(F.col("v"), F.col("spec")))
        .groupBy("ecosystem", "_name", "version", "id")
        # Only whether a notice is informational counts on; a text's maximum would have the hits sorted.
        .agg(F.max("score").alias("score"), F.max(F.when(F.col("informational").isNotNull(), 1)).alias("informational"))
    )
    return (
        packages.withColumn("_name", F.lower("name"))
        .join(hits, ["ecosystem", "_name", "version"])
        .select(
            "repo", "source_file", "ecosystem", "name", "version", F.col("id").alias("advisory"),
            F.when(F.col("informational").isNotNull(), "sca_unmaintained_dependency")
            .otherwise("sca_vulnerable_dependency").alias("invariant_id"),
            V.cvss_severity(F.col("score"), F.col("informational")).alias("severity"),
            V.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"),
        )
    )


def adjacent_swap(a: Column, b: Column) -> Column:
    """Whether exchanging one pair of neighbouring characters turns a into b."""
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(
            a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)),
            a.substr(i + 2, F.length(a)),
        ) == b,
    )


def one_edit_apart(a: Column, b: Column) -> Column:
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (a != b) & (
        (F.levenshtein(a, b, 1) == 1) | adjacent_swap(a, b)
    )


def _without_one(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def typosquats(packages: DataFrame, popular: dict[str, list[str]] = REF.POPULAR) -> DataFrame:
    """Names one edit from a popular package; the first popular name in list order.

    The comparison runs on distinct names against a literal list, so there is
    no join and nothing grows beyond one candidate per name. Two names one edit or one swap
    apart are equal after each loses one character at most, so only names that meet
    a listed one so are compared.
    """
    names = packages.groupBy("ecosystem", "name").agg(
        F.min(F.struct("repo", "source_file", "version")).alias("first")
    )

    def target(n: Column, words: list[str]) -> Column:
        listed = F.array(*[F.struct(F.lit(w).alias("name"), F.lit(w.replace("_", "-")).alias("folded")) for w in words])
        renumbered = lambda p: n.startswith(p) & n.substr(F.length(p) + 1, F.length(n)).rlike("^[0-9]*$")
        shorter = F.transform(F.sequence(F.lit(0), F.length(n)), lambda i: F.concat(n.substr(F.lit(1), i), n.substr(i + 2, F.length(n))))
        meets = F.exists(shorter, lambda x: x.isin(*sorted(set().union(*(_without_one(w.replace("_", "-")) for w in words)))))
        near = F.filter(listed, lambda p: one_edit_apart(n, p["folded"]) & ~renumbered(p["folded"]))
        return F.when(~n.isin(*words) & meets, F.get(near, F.lit(0))["name"])

    def found(n: Column) -> Column:
        hit = F.lit(None).cast("string")
        for eco, words in popular.items():
            hit = F.when((F.col("ecosystem") == eco) & (F.length(n) >= 5), target(n, list(words))).otherwise(hit)
        return hit

    # A filter would repeat the folding wherever the name stands; bound, it is done once.
    hit = V.let(F.replace(F.lower("name"), F.lit("_"), F.lit("-")), found)
    return names.withColumn("target", TX.once(hit)).filter(F.col("target").isNotNull()).select(
        "ecosystem", "name", "target", "first.repo", "first.source_file", "first.version"
    )


# Manifests and the lockfiles that pin them.
MANIFESTS = {
    "package.json": ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock"),
    "pyproject.toml": ("poetry.lock", "pdm.lock", "uv.lock", "requirements.txt", "Pipfile.lock"),
    "Pipfile": ("Pipfile.lock",),
    "go.mod": ("go.sum",),
}


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def missing_lockfile(files: DataFrame) -> DataFrame:
    """Manifests with no lockfile beside them; a package.json only if it has dependencies."""
    name = L.file_name(F.col("path"))
    pins = F.create_map(*[
        x for m, locks in MANIFESTS.items() for x in (F.lit(m), F.array(*[F.lit(l) for l in locks]))
    ])
    manifests = files.filter(
        name.isin(*MANIFESTS)
        & ((name != "package.json") | F.col("source").rlike('"dependencies"|"devDependencies"'))
    ).select("repo", "path", folder(F.col("path")).alias("dir"), name.alias("manifest"))
    locks = files.select(
        "repo", folder(F.col("path")).alias("dir"),
        F.explode(F.array_compact(F.array(*[
            F.when(name.isin(*ls), F.lit(m)) for m, ls in MANIFESTS.items()
        ]))).alias("manifest"),
    )
    return manifests.join(locks, ["repo", "dir", "manifest"], "left_anti").select(
        "repo", F.col("path").alias("file"), "manifest"
    )


def missing_integrity(files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Lockfile entries without a hash, of all entries that should have one.

    ``entries`` are the files' ``npm_entries``, where a caller has them already.
    """
    local = F.coalesce("link", F.lit(False)) | F.coalesce(F.col("resolved").startswith("file:"), F.lit(False))
    npm = (L.npm_entries(files) if entries is None else entries).filter(~local).groupBy("repo", "path").agg(
        F.count_if(F.col("integrity").isNull() & F.col("resolved").isNotNull()).alias("missing"),
        F.count("*").alias("total"),
    )
    blocks = files.filter(L.file_name(F.col("path")) == "Cargo.lock").select(
        "repo", "path", F.slice(F.split("source", r"\[\[package\]\]"), F.lit(2), F.size(F.split("source", r"\[\[package\]\]"))).alias("b")
    )
    registry = lambda b: F.contains(b, F.lit('source = "registry+'))
    cargo = blocks.select(
        "repo", "path",
        F.size(F.filter("b", lambda b: registry(b) & ~F.contains(b, F.lit("checksum = ")))).cast("long").alias("missing"),
        F.size(F.filter("b", registry)).cast("long").alias("total"),
    )
    count = lambda p: F.size(F.regexp_extract_all("source", F.lit(p), F.lit(0))).cast("long")
    yarn = files.filter(L.file_name(F.col("path")) == "yarn.lock").select(
        "repo", "path",
        (count(r"\n  version ") - count(r"\n  integrity |\n  checksum: ")).alias("missing"),
        count(r"\n  version ").alias("total"),
    )
    return npm.unionByName(cargo).unionByName(yarn).filter(F.col("missing") > 0)


def install_scripts(files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Packages that run code at install time, one row each."""
    local = F.coalesce("link", F.lit(False)) | F.coalesce(F.col("resolved").startswith("file:"), F.lit(False))
    return (L.npm_entries(files) if entries is None else entries).filter(~local & F.coalesce("hasInstallScript", F.lit(False))).select(
        "repo", F.col("path").alias("file"), F.col("name").alias("package")
    )


def unmapped_scopes(manifest_deps: DataFrame, lock_entries: DataFrame, npmrc: DataFrame) -> DataFrame:
    """npm scopes with no proof of being public and no registry mapping.

    ``manifest_deps(repo, dir, name, spec)``, ``lock_entries(repo, dir, name,
    resolved)`` and ``npmrc(repo, dir, source)``.
    """
    scope = F.regexp_extract("name", "^@([^/]+)", 1)
    asked = manifest_deps.filter(
        F.col("name").startswith("@") & ~F.col("spec").rlike("^(file:|link:|workspace:|git)")
    ).select("repo", "dir", scope.alias("scope")).distinct().filter(
        ~F.col("scope").isin(*REF.PUBLIC_SCOPES)
    )
    public = F.coalesce("resolved", F.lit("")).rlike("^https://registry\\.(npmjs\\.org|yarnpkg\\.com)/")
    proven = (
        lock_entries.filter(F.col("name").startswith("@"))
        .groupBy("repo", "dir", scope.alias("scope"))
        .agg(F.bool_and(public).alias("all_public"))
        .filter("all_public")
    )
    mapped = npmrc.select(
        "repo", F.col("dir").alias("_rc"),
        F.explode(F.regexp_extract_all("source", F.lit(r"@([^:\s/]+):registry"), F.lit(1))).alias("scope"),
    ).distinct()
    left = asked.join(proven, ["repo", "dir", "scope"], "left_anti")
    return left.join(
        mapped,
        (left["repo"] == mapped["repo"]) & (left["scope"] == mapped["scope"])
        & ((mapped["_rc"] == left["dir"]) | (mapped["_rc"] == "")),
        "left_anti",
    )


def npm_manifest_deps(files: DataFrame) -> DataFrame:
    schema = "struct<" + ",".join(
        f"{s}:map<string,string>" for s in ("dependencies", "devDependencies", "optionalDependencies")
    ) + ">"
    doc = files.filter(L.file_name(F.col("path")) == "package.json").withColumn("doc", F.from_json("source", schema))
    none = F.create_map().cast("map<string,string>")
    merged = F.map_entries(F.coalesce("doc.dependencies", none))
    for s in ("devDependencies", "optionalDependencies"):
        merged = F.concat(merged, F.map_entries(F.coalesce(f"doc.{s}", none)))
    return doc.select("repo", folder(F.col("path")).alias("dir"), F.inline(merged).alias("name", "spec"))


def unpinned_requirements(files: DataFrame) -> DataFrame:
    """Requirement lines not fixed to an exact version."""
    scoped = files.filter(L.file_name(F.col("path")).rlike(r"^requirements.*\.txt$"))
    lines = scoped.select("repo", F.col("path").alias("file"), F.posexplode(TX.split_lines(F.col("source"))).alias("pos", "raw"))
    req = F.trim(F.substring_index("raw", "#", 1))
    return lines.select("repo", "file", (F.col("pos") + 1).cast("long").alias("line"), req.alias("requirement")).filter(
        (F.col("requirement") != "") & ~F.col("requirement").rlike(r"^-|==| @ |://")
    )


def extra_index(files: DataFrame) -> DataFrame:
    """Lines that make pip search a second index."""
    scoped = files.filter(
        L.file_name(F.col("path")).isin("requirements.txt", "requirements-dev.txt", "pip.conf", "pip.ini")
    )
    lines = scoped.select("repo", F.col("path").alias("file"), F.posexplode(TX.split_lines(F.col("source"))).alias("pos", "raw"))
    return lines.filter(F.trim("raw").rlike("^(--)?extra-index-url")).select(
        "repo", "file", (F.col("pos") + 1).cast("long").alias("line"), F.trim("raw").alias("snippet")
    )


def sbom_components(packages: DataFrame) -> DataFrame:
    """One CycloneDX component per distinct package of a repository."""
    c = packages.select("repo", *COORDINATES).distinct()
    return c.withColumn("purl", V.purl(F.col("ecosystem"), F.col("name"), F.col("version")))


def sbom(packages: DataFrame) -> DataFrame:
    """One CycloneDX 1.5 document per repository.

    A document is one cell; its size is bounded by the distinct packages of one
    repository. Use ``sbom_components`` where a repository is a whole estate.
    """
    component = F.struct(
        F.lit("library").alias("type"), F.col("purl").alias("bom-ref"), F.col("name"),
        F.col("version"), F.col("purl"),
    )
    docs = sbom_components(packages).groupBy("repo").agg(
        F.array_sort(F.collect_list(component)).alias("components")
    )
    return docs.select(
        "repo",
        F.to_json(F.struct(
            F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"),
            F.lit(1).alias("version"), F.col("components"),
        )).alias("document"),
        F.size("components").cast("long").alias("n_components"),
    )
