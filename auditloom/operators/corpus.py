"""From trees of files to classified files, lines and functions.

A file is one row until a rule has hit: anything a rule needs from the rest of
its file (guards, neighbouring lines, the enclosing function) is evaluated on
the row's own line array. The scan therefore needs no shuffle, and a repository
holding a third of all files splits like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX

# Extensions and names that decide the kind of a file.
SKIP_EXTENSIONS = (
    "md", "rst", "txt", "pub", "lock", "sum", "svg", "png", "jpg", "gif", "ico",
    "woff", "woff2", "ttf", "pdf", "map",
)
SKIP_ENDINGS = (".example", ".sample", ".template", ".dist", ".min.js")
SKIP_FOLDERS = (
    "node_modules", "vendor", "target", "dist", "build", ".next", ".nuxt", ".cache",
    "coverage", "__pycache__", ".venv", ".git",
)
KIND_BY_EXTENSION = {
    "Python": ("py", "pyw"),
    "JavaScript": ("js", "jsx", "ts", "tsx", "mjs", "cjs"),
    "Go": ("go",),
    "Shell": ("sh", "bash", "zsh"),
    "ContainerManifest": ("yml", "yaml"),
    "Terraform": ("tf", "tfvars", "hcl"),
    "Config": ("env", "json", "toml", "ini", "cfg", "conf", "properties", "xml"),
}


def file_kind(path: Column) -> Column:
    """The kind of a file from its path alone."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.substring_index(p, "/", -1)
    ext = F.substring_index(name, ".", -1)
    folders = "|".join(d.replace(".", r"\.") for d in SKIP_FOLDERS)
    skip = (
        ext.isin(*SKIP_EXTENSIONS)
        | name.rlike("(" + "|".join(e.replace(".", r"\.") for e in SKIP_ENDINGS) + ")$")
        | p.rlike(f"/({folders})/")
    )
    kind = (
        F.when(skip, "Skip")
        .when(F.contains(p, F.lit(".github/workflows/")) & ext.isin("yml", "yaml"), "GithubWorkflow")
        .when(
            name.isin("dockerfile", "containerfile") | name.startswith("dockerfile.") | (ext == "dockerfile"),
            "Dockerfile",
        )
    )
    for label, extensions in KIND_BY_EXTENSION.items():
        kind = kind.when(ext.isin(*extensions), label)
    return kind.when(name.startswith(".env"), "Config").otherwise("Other")


def classify_files(files: DataFrame) -> DataFrame:
    return files.withColumn("kind", file_kind(F.col("path")))


def explode_lines(files: DataFrame) -> DataFrame:
    """1-based lines of every file."""
    keep = [c for c in files.columns if c != "source"]
    return files.select(
        *keep, F.posexplode(TX.split_lines(F.col("source"))).alias("pos", "text")
    ).select(*keep, (F.col("pos") + 1).cast("long").alias("line"), "text")


# Languages with their own analyzer, by extension or content marker.
ENGINE_EXTENSIONS = {"evm": r"\.sol$", "move": r"\.move$"}
SOLANA_MARKERS = r"#\[program\]|anchor_lang"
SOROBAN_MARKER = "soroban_sdk"


def route_engines(files: DataFrame) -> DataFrame:
    """One row per (file, rule pack) the file must go through."""
    rust = F.col("path").rlike(r"\.rs$")
    solana = rust & F.col("source").rlike(SOLANA_MARKERS)
    soroban = rust & ~solana & F.contains(F.col("source"), F.lit(SOROBAN_MARKER))
    engines = F.array_compact(
        F.array(
            *[F.when(F.col("path").rlike(p), F.lit(e)) for e, p in ENGINE_EXTENSIONS.items()],
            F.when(solana, F.lit("solana")),
            F.when(soroban, F.lit("soroban")),
            F.when(file_kind(F.col("path")) != "Skip", F.lit("general")),
        )
    )
    return files.withColumn("engine", F.explode(engines))


# What in a path shows that a repository has something to check.
SCOPE_PATTERNS = {
    "contracts": r"\.(sol|move)$|(programs/|contracts/).*\.rs$",
    "web": r"\.(py|js|ts|tsx|go|jsx|mjs)$",
    "deps": r"(cargo\.lock|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|requirements\.txt|poetry\.lock"
            r"|pipfile\.lock|go\.sum|package\.json|cargo\.toml|pyproject\.toml|go\.mod)$",
    "ci": r"^\.github/workflows/|(\.gitlab-ci\.yml|jenkinsfile)$",
    "containers": r"dockerfile$|dockerfile\.|docker-compose|k8s/|kubernetes/|helm/",
    "iac": r"\.tf$|cloudformation|template\.ya?ml$",
}


def repo_scope(files: DataFrame) -> DataFrame:
    """One row per repository: which families of checks apply to it."""
    p = F.lower("path")
    return files.groupBy("repo").agg(
        *[F.bool_or(p.rlike(rx)).alias(name) for name, rx in SCOPE_PATTERNS.items()]
    )


# What marks a contract file as test harness.
HARNESS_PATHS = r"\.[ts]\.sol$"
HARNESS_MARKERS = (
    r"(?m)^\s*import\s+[^;]*forge-std|\bis\s+(?:[\w, ]*\b)?(Test|StdInvariant|StdAssertions)\b"
    r"|\bfunction\s+setUp\s*\(|\bfunction\s+(echidna_|invariant_|property_)\w*\s*\("
    r"|\bIHevm\b|\bHevm\s*\(|\bvm\.(prank|startPrank|deal|warp|roll|expectRevert)\s*\("
)


def drop_test_harness(files: DataFrame, markers: str = HARNESS_MARKERS) -> DataFrame:
    """Files that are neither tests nor scripts, by path and by content."""
    return files.filter(
        ~F.lower("path").rlike(HARNESS_PATHS) & ~F.col("source").rlike(markers)
    )


def file_inventory(files: DataFrame) -> DataFrame:
    """Per file: lines, code lines, doc comments and test functions."""
    arr = TX.split_lines(F.col("source"))

    def count(pred) -> Column:
        return F.size(F.filter(arr, pred)).cast("long")

    return files.select(
        "repo", "path",
        F.size(arr).cast("long").alias("lines"),
        count(lambda l: ~l.rlike(r"^\s*($|//|#|/\*|\*)")).alias("code_lines"),
        count(lambda l: l.rlike(r"^\s*//[/!]")).alias("doc_comments"),
        count(lambda l: l.rlike(r"function\s+test|#\[test\]|#\[tokio::test\]|\bit\(")).alias("tests"),
    )


# Debt markers behind a comment opener.
DEBT_MARKERS = r"(?i)(?://|/\*|#|\*)\s*(TODO|FIXME|HACK|XXX|BUG|WORKAROUND|UNSAFE|DO NOT|@audit(?:-\w+)?)\b[:\s]*(.*)"


def tech_debt(files: DataFrame, pattern: str = DEBT_MARKERS, max_chars: int | None = None) -> DataFrame:
    """Debt comments with their text, whole or cut to ``max_chars`` for display."""
    lines = explode_lines(files.filter(F.col("source").rlike(pattern)))
    note = F.trim(F.regexp_extract("text", pattern, 2))
    return lines.filter(F.col("text").rlike(pattern)).select(
        "repo", "path", "line",
        F.upper(F.regexp_extract("text", pattern, 1)).alias("type"),
        (note if max_chars is None else F.substring(note, 1, max_chars)).alias("note"),
    )


def missing_lines(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted lines a file does not have; blanks and comments do not count."""
    have = existing.select("repo", "path", F.trim("text").alias("want_key")).distinct()
    asked = wanted.withColumn("want_key", F.trim("text")).filter(
        (F.col("want_key") != "") & ~F.col("want_key").startswith("#")
    )
    return asked.join(have, ["repo", "path", "want_key"], "left_anti").drop("want_key")
