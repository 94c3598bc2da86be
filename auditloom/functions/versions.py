"""Package versions as sortable structs, requirement matching, package names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let


def version_key(text: Column) -> Column:
    """``struct(core array<bigint>, rank int, tag string, width int)``; NULL if unparseable.

    Order: numeric core of any length, then rank (tag 0 < release 1 < post 2), then tag. The core has no
    trailing zeros, as a missing component counts as zero and arrays are ordered item by item.
    """
    cleaned = F.split_part(
        F.regexp_replace(F.regexp_replace(F.trim(text), "^v+", ""), "^=+", ""), F.lit("+"), F.lit(1)
    )

    def split(s: Column) -> Column:
        return F.struct(
            F.split(F.split_part(s, F.lit("-"), F.lit(1)), r"\.").alias("parts"),
            F.when(F.locate("-", s) > 0, F.regexp_extract(s, r"^[^-]*-([\s\S]*)$", 1)).alias("dash"),
        )

    def locate(p: Column) -> Column:
        # Position of the first segment that is not purely numeric; it ends the core.
        odd = F.array_position(F.transform(p["parts"], lambda x: ~x.rlike("^[0-9]+$")), F.lit(True))
        return F.struct(p["parts"].alias("parts"), p["dash"].alias("dash"), odd.cast("int").alias("stop"))

    def read(p: Column) -> Column:
        tagged = p["stop"] > 0
        odd = F.get(p["parts"], p["stop"] - 1)
        digits = F.regexp_extract(odd, "^([0-9]*)", 1)
        whole = F.when(tagged, F.slice(p["parts"], F.lit(1), p["stop"] - 1)).otherwise(p["parts"])
        segments = F.when(tagged & (digits != ""), F.concat(whole, F.array(digits))).otherwise(whole)
        upto = F.when(tagged, F.slice(p["parts"], F.lit(1), p["stop"])).otherwise(p["parts"])
        return F.struct(
            F.transform(segments, lambda x: x.try_cast("bigint")).alias("numbers"),
            F.coalesce(p["dash"], F.when(tagged, F.regexp_extract(odd, r"^[0-9]*([\s\S]*)$", 1))).alias("tag"),
            F.exists(upto, lambda x: x == "").alias("hole"),
        )

    def finish(v: Column) -> Column:
        # An empty segment, an overflowing number or no number at all is no version.
        bad = (
            v["hole"] | (F.size(v["numbers"]) == 0) | F.exists(v["numbers"], lambda n: n.isNull())
        )
        last = F.array_max(F.transform(v["numbers"], lambda n, i: F.when(n != 0, i + 1)))
        core = F.slice(v["numbers"], F.lit(1), F.coalesce(last, F.lit(0)))
        rank = F.when(v["tag"].isNull(), 1).when(v["tag"].startswith("post"), 2).otherwise(0)
        return F.when(
            ~bad,
            F.struct(
                core.alias("core"), rank.cast("int").alias("rank"),
                F.coalesce(v["tag"], F.lit("")).alias("tag"), F.size(v["numbers"]).alias("width"),
            ),
        )

    parsed = let(cleaned, lambda s: let(split(s), lambda p: let(locate(p), lambda q: let(read(q), finish))))
    return F.when(text.isNotNull(), parsed)


def sort_key(version: Column) -> Column:
    """The comparable part of a version key; NULL stays NULL."""
    return F.when(version.isNotNull(), F.struct(version["core"], version["rank"], version["tag"]))


def compare_versions(a: Column, b: Column) -> Column:
    """-1 / 0 / 1 of two version texts; NULL when either does not parse."""
    pair = F.struct(sort_key(version_key(a)).alias("a"), sort_key(version_key(b)).alias("b"))
    return let(
        pair,
        lambda p: F.when(p["a"].isNull() | p["b"].isNull(), None)
        .when(p["a"] < p["b"], -1).when(p["a"] > p["b"], 1).otherwise(0),
    )


OPERATORS = r"^(<=|>=|<|>|=|\^|~)"


def requirement_clauses(requirement: Column) -> Column:
    """A comma-separated requirement as ``array<struct<op, key>>``; parse it once, match it often."""
    texts = F.filter(F.transform(F.split(requirement, ","), lambda c: F.trim(c)), lambda c: c != "")
    return F.transform(
        texts,
        lambda c: F.struct(
            F.regexp_extract(c, OPERATORS, 1).alias("op"),
            version_key(F.trim(F.regexp_replace(c, OPERATORS, ""))).alias("key"),
        ),
    )


def clauses_match(v: Column, clauses: Column) -> Column:
    """Whether a version key meets every parsed clause; an unparseable target never matches."""
    return F.forall(clauses, lambda c: F.coalesce(_clause(v, c["op"], c["key"]), F.lit(False)))


def req_matches(version: Column, requirement: Column) -> Column:
    """Whether a version text meets every comma-separated clause of a requirement."""
    both = F.struct(version_key(version).alias("v"), requirement_clauses(requirement).alias("c"))
    return let(both, lambda b: F.when(b["v"].isNotNull(), clauses_match(b["v"], b["c"])))


def _clause(v: Column, op: Column, t: Column) -> Column:
    sv, st = sort_key(v), sort_key(t)

    def at(k: Column, i: int) -> Column:
        return F.coalesce(F.get(k["core"], F.lit(i)), F.lit(0))

    same_major = at(v, 0) == at(t, 0)
    same_minor = at(v, 1) == at(t, 1)
    caret = (sv >= st) & same_major & F.when(at(t, 0) != 0, F.lit(True)).otherwise(
        same_minor
        & F.when(at(t, 1) != 0, F.lit(True)).otherwise(at(v, 2) == at(t, 2))
    )
    tilde = (sv >= st) & same_major & ((t["width"] < 2) | same_minor)
    return (
        F.when(op == ">=", sv >= st)
        .when(op == ">", sv > st)
        .when(op == "<=", sv <= st)
        .when(op == "<", sv < st)
        .when(op == "=", sv == st)
        .when(op == "~", tilde)
        .otherwise(caret)
    )


def normalize_package_name(ecosystem: Column, name: Column) -> Column:
    """PyPI names are case-insensitive and treat ``_``, ``.`` and ``-`` alike."""
    return F.when(ecosystem == "PyPI", F.translate(F.lower(name), "_.", "--")).otherwise(name)


# Package-URL types by ecosystem.
PURL_TYPES = {"crates.io": "cargo", "npm": "npm", "PyPI": "pypi", "Go": "golang"}


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    kind = F.create_map(*[F.lit(x) for kv in PURL_TYPES.items() for x in kv])[ecosystem]
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.lit("@"), version)


def cvss_score(text: Column) -> Column:
    """A number as is, else an estimate from the vector's impact metrics."""
    highs = sum(
        F.when(F.contains(text, F.lit(f"/{k}:H")), 1).otherwise(0) for k in ("C", "I", "A")
    )
    network = F.contains(text, F.lit("AV:N"))
    estimate = (
        F.when((highs == 3) & network, 9.8)
        .when(highs == 3, 7.8)
        .when((highs == 2) & network, 8.1)
        .when((highs == 1) & network, 7.5)
        .when(highs == 0, 5.3)
        .otherwise(6.5)
    )
    return F.when(text.isNotNull(), F.coalesce(text.try_cast("double"), estimate))


def cvss_severity(score: Column, informational: Column) -> Column:
    return (
        F.when(informational.isNotNull(), "Low")
        .when(score.isNull(), "High")
        .when(score >= 9.0, "Critical")
        .when(score >= 7.0, "High")
        .when(score >= 4.0, "Medium")
        .otherwise("Low")
    )


def osv_ranges(events: Column) -> Column:
    """Fold OSV events into ``array<struct<intro,end,inclusive>>`` (texts; NULL = open)."""
    range_type = "array<struct<intro:string,end:string,inclusive:boolean>>"
    start = F.struct(
        F.array().cast(range_type).alias("done"),
        F.lit(None).cast("string").alias("intro"),
        F.lit(False).alias("open"),
    )

    def close(acc: Column, end: Column, inclusive: bool) -> Column:
        return F.struct(
            F.concat(
                acc["done"],
                F.array(
                    F.struct(
                        acc["intro"].alias("intro"), end.alias("end"),
                        F.lit(inclusive).alias("inclusive"),
                    )
                ),
            ).cast(range_type).alias("done"),
            acc["intro"].alias("intro"),
            F.lit(False).alias("open"),
        )

    def step(acc: Column, ev: Column) -> Column:
        return (
            F.when(
                ev["introduced"].isNotNull(),
                F.struct(
                    acc["done"].alias("done"),
                    ev["introduced"].alias("intro"),
                    F.lit(True).alias("open"),
                ),
            )
            .when(ev["fixed"].isNotNull() & acc["open"], close(acc, ev["fixed"], False))
            .when(
                ev["last_affected"].isNotNull() & acc["open"],
                close(acc, ev["last_affected"], True),
            )
            .otherwise(acc)
        )

    def finish(acc: Column) -> Column:
        tail = F.array(
            F.struct(
                acc["intro"].alias("intro"),
                F.lit(None).cast("string").alias("end"),
                F.lit(False).alias("inclusive"),
            )
        )
        return F.when(acc["open"], F.concat(acc["done"], tail).cast(range_type)).otherwise(
            acc["done"]
        )

    return F.aggregate(events, start, step, finish)
