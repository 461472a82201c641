"""SQL for DuckDB that says what the registered queries compute, from the same rules and views."""

from __future__ import annotations

from maskmill.functions.columns import SENSITIVE_FIELD, STRICT_FIELD
from maskmill.functions.rules import BUILTIN, PLACEHOLDER, Rule
from maskmill.sources.derived import with_views


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def views(*names: str) -> str:
    return with_views(*names, string="varchar")


def fold(source: str, keys: str, col: str = "text", rules: tuple[Rule, ...] = BUILTIN, placeholder: str = PLACEHOLDER, count: bool = True) -> str:
    """CTEs f0, f1, ... : each rule counts (h0, h1, ...) and replaces in t what the one before left."""
    out = [f"f0 AS (SELECT {keys}, {col} AS t FROM {source})"]
    for i, r in enumerate(rules):
        p = quoted(r.pattern)
        before = "".join(f", h{j}" for j in range(i)) if count else ""
        own = f", len(regexp_extract_all(t, {p})) AS h{i}" if count else ""
        out.append(f"f{i + 1} AS (SELECT {keys}{before}{own}, regexp_replace(t, {p}, {quoted(r.replacement(placeholder, chr(92), chr(92)))}, 'g') AS t FROM f{i})")
    return ", ".join(out)


def long_hits(keys: str, rules: tuple[Rule, ...] = BUILTIN) -> str:
    """(keys, rule, hits) from the last of fold's CTEs."""
    pairs = ", ".join(f"{{'rule': {quoted(r.name)}, 'hits': h{i}}}" for i, r in enumerate(rules))
    return f"SELECT {keys}, u.rule AS rule, u.hits AS hits FROM (SELECT {keys}, unnest([{pairs}]) AS u FROM f{len(rules)}) WHERE u.hits > 0"


def total(rules: tuple[Rule, ...] = BUILTIN) -> str:
    return " + ".join(f"h{i}" for i in range(len(rules)))


def key_class(key: str) -> str:
    name = rf"regexp_replace(regexp_replace({key}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')"
    some, strict = (f"regexp_matches({name}, {quoted(p)})" for p in (SENSITIVE_FIELD, STRICT_FIELD))
    return f"CASE WHEN {some} AND {strict} THEN 'strict' WHEN {some} THEN 'sensitive' ELSE 'normal' END"


def partial(value: str) -> str:
    return f"CASE WHEN length({value}) <= 12 THEN {quoted(PLACEHOLDER)} ELSE substr({value}, 1, 4) || '...' || right({value}, 4) || ':' || substr(sha256({value}), 1, 8) END"
