"""Committed credentials: known token formats and high-entropy assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX
from . import corpus

# Public token formats.
KNOWN_FORMATS = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack_token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"\b[sr]k_live_[A-Za-z0-9]{16,}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_\-]{35}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
PRIVATE_KEY_HEADER = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
ASSIGNMENT = (
    r"(?i)(?:password|passwd|secret|token|api[_-]?key|access[_-]?key|credential)[a-z0-9_]*"
    r"""["']?\s*[:=]\s*["']([^"'\s]{8,})["']"""
)
MIN_ENTROPY = 3.0
# One of these words is in every text the shapes above can match.
SHAPE_WORDS = (
    "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "_live_", "aiza", "eyj", "private key",
    "password", "passwd", "secret", "token", "key", "credential",
)
KNOWN_PATTERN = "(" + "|".join(KNOWN_FORMATS.values()) + ")"


def secret_scan(files: DataFrame, min_entropy: float = MIN_ENTROPY, skip_docs: bool = True) -> DataFrame:
    """One row per credential on a line, with its kind and the raw value.

    A file with none of the words is dropped before it is split.
    """
    shapes = f"{KNOWN_PATTERN}|{PRIVATE_KEY_HEADER}|(?i:{ASSIGNMENT[4:]})"
    worded = lambda c: TX.let(F.lower(c), lambda low: TX.any_word(low, SHAPE_WORDS))
    scoped = files.filter(worded(F.col("source")))
    if skip_docs:
        scoped = scoped.filter(corpus.file_kind(F.col("path")) != "Skip")
    lines = corpus.explode_lines(scoped).filter(worded(F.col("text")) & F.col("text").rlike(shapes))
    known = F.transform(
        F.regexp_extract_all("text", F.lit(KNOWN_PATTERN), F.lit(1)),
        lambda v: F.struct(F.lit("gen_hardcoded_secret").alias("invariant_id"), v.alias("value")),
    )
    pem = F.transform(
        F.regexp_extract_all("text", F.lit(f"({PRIVATE_KEY_HEADER})"), F.lit(1)),
        lambda v: F.struct(F.lit("gen_private_key_committed").alias("invariant_id"), v.alias("value")),
    )
    generic = F.transform(
        F.filter(
            F.regexp_extract_all("text", F.lit(ASSIGNMENT), F.lit(1)),
            lambda v: ~TX.is_placeholder(v) & ~v.rlike(KNOWN_PATTERN) & (TX.entropy(v) >= min_entropy),
        ),
        lambda v: F.struct(F.lit("gen_hardcoded_secret").alias("invariant_id"), v.alias("value")),
    )
    return lines.select(
        "repo", F.col("path").alias("file"), "line", F.col("text").alias("snippet"),
        F.inline(F.concat(known, pem, generic)),
    )


def mask(value: Column) -> Column:
    """Keep the first four characters; a short value is masked whole."""
    return F.when(F.length(value) > 8, F.concat(F.substring(value, 1, 4), F.lit("****"))).otherwise("****")


def redact(findings: DataFrame) -> DataFrame:
    """Mask credentials in the snippets of the two credential rules."""
    masked = F.regexp_replace(
        F.regexp_replace("snippet", r"""(["'])([^"'\s]{4})[^"'\s]{4,}\1""", "$1$2****$1"),
        KNOWN_PATTERN, "****",
    )
    return findings.withColumn(
        "snippet",
        F.when(
            F.col("invariant_id").isin("gen_hardcoded_secret", "gen_private_key_committed"), masked
        ).otherwise(F.col("snippet")),
    )


def redact_cookie(value: Column) -> Column:
    """A Set-Cookie value without the value: name and attributes stay."""
    return F.concat(
        F.trim(F.regexp_extract(value, r"^([^=;]*)", 1)),
        F.lit("=<redacted>"),
        F.when(F.locate(";", value) > 0, F.regexp_extract(value, r"^[^;]*(;.+)$", 1)).otherwise(""),
    )
