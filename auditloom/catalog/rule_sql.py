"""SQL twins of rule packs, generated from the same rule rows."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators import rules as R
from .base import CODE_FILES, code_cte, lines_cte, q, with_ctes


def _flagged(pattern: str, tail: str) -> str:
    flag, inner = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return f"{flag}(?:{inner}){tail}"


def _match(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def argument_sql(rule: R.Rule) -> str:
    if rule.arg_from == "end":
        n = R.group_count(rule.pattern) + 1
        return f"regexp_extract(text, {q(_flagged(rule.pattern, '(.*)$'))}, {n})"
    head = f"regexp_extract(text, {q(_flagged(rule.pattern, '.*$'))}, 0)"
    return f"regexp_extract({head}, {q(chr(92) + '((.*)$')}, 1)"


def dynamic_sql(arg: str) -> str:
    letter = "^\\s*[\\p{L}_]"
    return (
        f"(contains({arg}, '${{') OR (NOT {_match(arg, R.LITERAL_ARGUMENT)} AND NOT {_match(arg, '^' + chr(92) + 's*($|' + chr(92) + '))')}"
        f" AND ({_match(arg, R.DYNAMIC_ARGUMENT)} OR {_match(arg, letter)})))"
    )


def line_sql(rule: R.Rule) -> list[str]:
    c = [_match("text", rule.pattern)]
    if rule.unless:
        c.append(f"NOT {_match('text', rule.unless)}")
    if rule.head:
        head = _match(f"regexp_extract(text, {q(_flagged(rule.pattern, '.*$'))}, 0)", rule.head)
        c.append(f"({head} OR {_match('text', rule.also)})" if rule.also else head)
    elif rule.also:
        c.append(_match("text", rule.also))
    arg = argument_sql(rule)
    if rule.argument == "dynamic":
        c.append(dynamic_sql(arg))
    if rule.arg_has:
        c.append(_match(arg, rule.arg_has))
    if rule.arg_lacks:
        c.append(f"NOT {_match(arg, rule.arg_lacks)}")
    if rule.each_match:
        c.append(
            f"len(list_filter(regexp_extract_all(text, {q(rule.pattern)}), lambda m: regexp_matches(m, {q(rule.each_match)}))) > 0"
        )
    return c


def pack_sql(rules: Sequence[R.Rule], columns: str = "repo, file, line, invariant_id, severity, snippet") -> str:
    """One SELECT per rule over numbered code lines, guards as correlated text."""
    span = lambda lo, hi: (
        "(SELECT string_agg(c2.text, chr(10) ORDER BY c2.line) FROM cl c2 WHERE c2.repo = h.repo AND c2.path = h.path"
        f" AND c2.line >= {lo} AND c2.line <= {hi})"
    )
    ctes = [CODE_FILES, lines_cte("code_files"), code_cte()]
    ctes.append(
        "ft AS MATERIALIZED (SELECT repo, path, string_agg(text, chr(10) ORDER BY line) AS body, count(*) AS n FROM cl GROUP BY ALL)"
    )
    ctes.append(f"fl AS MATERIALIZED (SELECT repo, path, line FROM cl WHERE {_match('text', R.FUNCTION_LINE)})")
    selects = []
    for p, r in enumerate(rules):
        kinds = ", ".join(q(k) for k in r.kinds)
        hit = f"SELECT repo, path, line, text FROM cl WHERE kind IN ({kinds}) AND " + " AND ".join(line_sql(r))
        cond = []
        joins = ""
        if r.secret_context:
            own = _match("h.text", R.SECRET_CONTEXT)
            near = (
                f"coalesce((SELECT {_match('c2.text', R.SECRET_CONTEXT)} FROM cl c2 WHERE c2.repo = h.repo AND c2.path = h.path"
                f" AND c2.line >= h.line - {R.SECRET_LOOKBACK} AND c2.line < h.line AND {_match('c2.text', R.SCOPE_NAME_LINE)}"
                " ORDER BY c2.line DESC LIMIT 1), false)"
            )
            cond.append(f"({own} OR {near})")
        near_text = span(f"h.line - {r.near[0]}", f"h.line + {r.near[1]}")
        if r.near_has:
            cond.append(_match(near_text, r.near_has))
        if r.near_lacks:
            cond.append(f"NOT {_match(near_text, r.near_lacks)}")
        if r.file_has or r.file_lacks:
            joins = " JOIN ft ON ft.repo = h.repo AND ft.path = h.path"
        if r.file_has:
            cond.append(_match("ft.body", r.file_has))
        if r.file_lacks:
            cond.append(f"NOT {_match('ft.body', r.file_lacks)}")
        if r.func_has or r.func_lacks or r.func_count:
            start = "coalesce((SELECT max(f.line) FROM fl f WHERE f.repo = h.repo AND f.path = h.path AND f.line <= h.line), 1)"
            nxt = "coalesce((SELECT min(f.line) FROM fl f WHERE f.repo = h.repo AND f.path = h.path AND f.line > h.line), 1000000000)"
            hit = f"SELECT *, {start} AS s0, {nxt} AS e0 FROM ({hit}) h"
            body = span("h.s0", "greatest(h.e0 - 1, h.line)")
            if r.func_has:
                cond.append(_match(body, r.func_has))
            if r.func_lacks:
                cond.append(f"NOT {_match(body, r.func_lacks)}")
            if r.func_count:
                cond.append(f"len(regexp_extract_all({body}, {q(r.func_count[0])})) >= {r.func_count[1]}")
        where = (" WHERE " + " AND ".join(cond)) if cond else ""
        sel = (
            f"SELECT h.repo, h.path AS file, h.line, {q(r.rule_id)} AS invariant_id, {q(r.severity)} AS severity,"
            f" trim(h.text) AS snippet, {p} AS p FROM ({hit}) h{joins}{where}"
        )
        if r.first_only:
            sel = f"SELECT * FROM ({sel}) QUALIFY row_number() OVER (PARTITION BY repo, file ORDER BY line) = 1"
        selects.append(f"({sel})")
    return with_ctes(*ctes, body=f"SELECT {columns} FROM (" + "\nUNION ALL\n".join(selects) + ")")
