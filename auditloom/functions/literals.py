"""Literals a regular expression cannot match without.

A substring test is far cheaper than a regex search. For a pattern such as
``\\b(eval|exec)\\s*\\(`` every match contains "eval" or "exec", so lines with
neither need no search. The answer is a set of lower-case texts, compared with
the lower-cased line; None means nothing useful is required.
"""

from __future__ import annotations

from re import _constants as C, _parser as P

LIMIT = 24
SHORTEST = 3


def required_literals(pattern: str) -> tuple[str, ...] | None:
    found = _needed(list(P.parse(pattern)))
    return tuple(sorted(found)) if found else None


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set with the longer shortest member; fewer members on a tie."""
    rank = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
    return a if rank(a) >= rank(b) else b


def _needed(nodes: list) -> set[str] | None:
    best: set[str] | None = None
    run = {""}
    for op, arg in nodes:
        texts = _texts(op, arg)
        if texts is not None and len(run) * len(texts) <= LIMIT:
            run = {r + t for r in run for t in texts}
            continue
        best = _better(best, _usable(run))
        run = {""}
        if texts is not None and len(texts) <= LIMIT:
            run = set(texts)
        else:
            best = _better(best, _inside(op, arg))
    return _better(best, _usable(run))


def _usable(run: set[str]) -> set[str] | None:
    return {r.lower() for r in run} if run and min(map(len, run)) >= SHORTEST else None


def _texts(op, arg) -> set[str] | None:
    """All texts of a node that matches only literal text, else None."""
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.AT:
        return {""}
    if op is C.SUBPATTERN:
        return _sequence(list(arg[3]))
    if op is C.BRANCH:
        parts = [_sequence(list(b)) for b in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    return None


def _sequence(nodes: list) -> set[str] | None:
    run = {""}
    for op, arg in nodes:
        texts = _texts(op, arg)
        if texts is None or len(run) * len(texts) > LIMIT:
            return None
        run = {r + t for r in run for t in texts}
    return run


def _inside(op, arg) -> set[str] | None:
    """What a compound node needs."""
    if op is C.SUBPATTERN:
        return _needed(list(arg[3]))
    if op is C.BRANCH:
        parts = [_needed(list(b)) for b in arg[1]]
        return set().union(*parts) if all(parts) else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
        return _needed(list(arg[2]))
    return None
