"""Severity scales, exploitability, fingerprints and names of findings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The two severity scales. They differ on purpose: the ordinal
# scale keeps Info apart, the gate scale counts it as low.
SEVERITY_RANK = {"Info": 0, "Low": 1, "Medium": 2, "High": 3, "Critical": 4}
GATE_RANK = {"info": 0, "low": 0, "medium": 1, "high": 2, "critical": 3}

# Analyzer by the first segment of a rule id.
ANALYZER_BY_PREFIX = {
    "evm": "evm", "sol": "solana", "move": "move", "sor": "soroban",
    "gen": "general", "sca": "supply-chain", "rt": "runtime",
}

# Exploitability labels, weakest first.
EXPLOITABILITY = ("THEORETICAL", "UNLIKELY", "POSSIBLE", "LIKELY")


def lookup(mapping: dict, key: Column) -> Column:
    """A small constant map as an expression; absent keys give NULL."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def severity_rank(severity: Column) -> Column:
    return lookup(SEVERITY_RANK, severity)


def gate_rank(severity: Column) -> Column:
    return F.coalesce(lookup(GATE_RANK, F.lower(severity)), F.lit(0))


def exploitability_rank(label: Column) -> Column:
    return lookup({name: i for i, name in enumerate(EXPLOITABILITY)}, label)


def chain_of(invariant_id: Column) -> Column:
    return lookup(ANALYZER_BY_PREFIX, F.split_part(invariant_id, F.lit("_"), F.lit(1)))


def title_of(invariant_id: Column) -> Column:
    """Readable title: prefix off, underscores to spaces, first letter up."""
    words = F.replace(
        F.regexp_replace(invariant_id, "^(evm|sol|move|sor|gen|sca|rt)_", ""),
        F.lit("_"), F.lit(" "),
    )
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))


def exploitability_score(vector: Column, prereq: Column, interaction: Column, proven: Column) -> Column:
    base = F.when(vector == "network", 3).when(vector == "adjacent", 2).when(vector == "local", 1)
    return (
        base
        - F.when(prereq == "none", 0).when(prereq == "privileged", 2).otherwise(1)
        - F.when(interaction == "required", 1).otherwise(0)
        + F.when(proven, 1).otherwise(0)
    )


def exploitability(vector: Column, prereq: Column, interaction: Column, proven: Column) -> Column:
    score = exploitability_score(vector, prereq, interaction, proven)
    return (
        F.when(score >= 3, "LIKELY").when(score == 2, "POSSIBLE")
        .when(score == 1, "UNLIKELY").when(score.isNotNull(), "THEORETICAL")
    )


# The sentence behind each part of a rating.
REASONS = {
    "network": "reachable by anyone who can reach the service or submit a transaction",
    "adjacent": "requires an on-path, same-chain or mempool position",
    "local": "requires repository, CI or host access",
    "none": "no account, token or role needed",
    "authenticated": "needs a valid account or token holding",
    "condition": "needs a specific state or configuration to be present",
    "privileged": "needs a privileged role — an insider or a compromised admin",
    "required": "a victim must act (visit a page, click, or be on a hostile network)",
    "proven": "observed live by the probe, not inferred from text",
}


def exploit_reasons(vector: Column, prereq: Column, interaction: Column, proven: Column) -> Column:
    return F.array_compact(
        F.array(
            lookup(REASONS, vector),
            lookup(REASONS, prereq),
            F.when(interaction == "required", REASONS["required"]),
            F.when(proven, REASONS["proven"]),
        )
    )


def fingerprint(severity: Column, name: Column, file: Column, line: Column) -> Column:
    """SHA-256 of the NUL-joined identity fields."""
    return F.sha2(
        F.concat_ws(
            "\0",
            F.coalesce(severity, F.lit("")), F.coalesce(name, F.lit("")),
            F.coalesce(file, F.lit("")), F.coalesce(line.cast("string"), F.lit("")),
        ),
        256,
    )


# Report levels and scores by severity.
SARIF_LEVEL = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note", "Info": "note"}
SECURITY_SEVERITY = {"Critical": "9.5", "High": "8.0", "Medium": "5.5", "Low": "3.0", "Info": "1.0"}
