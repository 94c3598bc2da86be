"""Line-level text functions, all native Column expressions.

The patterns use possessive quantifiers so that Java's regex engine walks long
quoted runs in a loop instead of recursing; a one-line 100 kB file is safe.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .literals import required_literals

_DQ = r'"(?:[^"\\]++|\\.)*+(?:"|\\?$)'
_SQ = r"'(?:[^'\\]++|\\.)*+(?:'|\\?$)"
_BT = r"`(?:[^`\\]++|\\.)*+(?:`|\\?$)"


def strip_hash_comment(line: Column) -> Column:
    """Cut a ``#`` comment that is outside quotes."""
    cut = F.regexp_replace(line, f"({_DQ}|{_SQ})|#.*$", "$1")
    return F.when(F.contains(line, F.lit("#")), cut).otherwise(line)


def strip_slash_comment(line: Column) -> Column:
    """Cut ``//`` and ``/* */`` comments outside quotes and template literals."""
    cut = F.regexp_replace(line, rf"({_DQ}|{_SQ}|{_BT})|//.*$|/\*.*?(?:\*/|$)", "$1")
    return F.when(F.contains(line, F.lit("/")), cut).otherwise(line)


def code_only(line: Column) -> Column:
    """Empty every string literal, then drop the rest of the line from a comment on."""
    emptied = F.regexp_replace(
        line,
        r'(//.*$|/\*.*$)|(")(?:[^"\\]++|\\.)*+(?:(")|\\?$)|(' + r"')(?:[^'\\]++|\\.)*+(?:(')|\\?$)",
        "$2$3$4$5",
    )
    return emptied


def split_lines(source: Column) -> Column:
    """Lines of a text; a trailing newline does not start another line.

    Plain text functions do the common work: only a text with carriage returns
    is rewritten, and a one-character split needs no regular expression.
    """
    unix = F.when(F.contains(source, F.lit("\r\n")), F.replace(source, F.lit("\r\n"), F.lit("\n"))).otherwise(source)
    body = F.when(unix.endswith("\n"), F.substr(unix, F.lit(1), F.length(unix) - 1)).otherwise(unix)
    return F.split(body, "\n")


def code_lines(source: Column, kind: Column) -> Column:
    """Lines without comments; the comment style is chosen once per file."""
    lines = split_lines(source)
    return F.when(
        kind.isin("JavaScript", "Go"), F.transform(lines, strip_slash_comment)
    ).otherwise(F.transform(lines, strip_hash_comment))


def once(value: Column) -> Column:
    """Evaluate ``value`` a single time per row.

    The optimizer may inline a projected column into every place that uses it;
    a generator is a boundary it does not move expressions across.
    """
    return F.explode(F.array(value))


def let(value: Column, body) -> Column:
    """Bind a value once for ``body``; a plain reference would be evaluated per use."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def any_word(low: Column, words) -> Column:
    """Whether a lower-cased text contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def search(text: Column, pattern: str) -> Column:
    """``rlike`` behind a substring test that every match passes."""
    words = required_literals(pattern)
    if not words:
        return text.rlike(pattern)
    return let(F.lower(text), lambda low: any_word(low, words)) & text.rlike(pattern)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per UTF-8 byte; 0 for the empty string."""
    n = F.octet_length(value)
    octets = F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit("(..)"), F.lit(1))

    def information(acc: Column, octet: Column) -> Column:
        share = F.size(F.filter(octets, lambda o: o == octet)) / n
        return acc - share * F.log2(share)

    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.aggregate(F.array_distinct(octets), F.lit(0.0), information)
    )


# Markers that make a literal a placeholder, not a credential.
PLACEHOLDER_PARTS = (
    "example", "changeme", "local-only", "localonly", "dev-only", "devonly",
    "not-a-secret", "notasecret", "insecure", "change_me", "placeholder",
    "your_", "your-", "<your", "dummy", "fake", "xxxx", "****", "...",
    "os.environ", "process.env", "getenv", "secrets.", "vault:",
)
PLACEHOLDER_STARTS = ("${", "{{", "$", "<")
MIN_CREDENTIAL_LENGTH = 8


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


PLACEHOLDER_PATTERN = "|".join(
    [_literal(p) for p in PLACEHOLDER_PARTS]
    + ["^(?:" + "|".join(_literal(p) for p in PLACEHOLDER_STARTS) + ")", "^[x0*\\-]*$"]
)


def is_placeholder(value: Column) -> Column:
    """Whether a literal is a stand-in rather than a credential."""
    v = F.lower(F.trim(F.trim(value), F.lit("\"'")))
    return (F.length(v) < MIN_CREDENTIAL_LENGTH) | v.rlike(PLACEHOLDER_PATTERN)


# Whole-file rewriting needs a replacement that depends on the match (keep the
# newlines), which no built-in expression offers: one Arrow batch per call.

@F.pandas_udf(T.StringType())
def strip_block_comments(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Remove block comments outside strings, keeping line numbers."""
    import re

    token = re.compile(
        r'"(?:[^"\\]|\\.)*(?:"|\Z)' r"|'(?:[^'\\]|\\.)*(?:'|\Z)" r"|//[^\n]*|/\*.*?(?:\*/|\Z)",
        re.S,
    )

    def keep(m: "re.Match[str]") -> str:
        return "\n" * m[0].count("\n") if m[0].startswith("/*") else m[0]

    for batch in sources:
        yield batch.map(lambda s: token.sub(keep, s), na_action="ignore")


@F.pandas_udf(T.StringType())
def strip_raw_strings(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Blank the body of raw string literals, keeping line numbers."""
    import re

    token = re.compile(r'(?<![A-Za-z0-9_])(r(#*)")(.*?)("\2)', re.S)
    for batch in sources:
        yield batch.map(
            lambda s: token.sub(lambda m: m[1] + "\n" * m[3].count("\n") + m[4], s),
            na_action="ignore",
        )
