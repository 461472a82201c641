"""Column expressions: masks, field names, media types, urls and usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DEFAULT, Policy, Rule

# Field names that mark a secret, and those that mark it for sure.
SENSITIVE_FIELD = (
    r"(?i)(?:^|[_.-])(?:api[_-]?keys?|client[_-]?secrets?|secrets?|passwords?|passwd|pwd|tokens?|access[_-]?tokens?|refresh[_-]?tokens?|id[_-]?tokens?|auth|"
    r"authorization|auth[_-]?tokens?|session[_-]?tokens?|private[_-]?keys?|secret[_-]?(?:access[_-]?)?keys?|access[_-]?keys?|account[_-]?keys?|"
    r"signing[_-]?keys?|encryption[_-]?keys?|credentials?|webhook[_-]?urls?|x[_-]?api[_-]?key|api[_-]?key|x[_-]?auth[_-]?key|x[_-]?auth[_-]?token|"
    r"cf[_-]?access[_-]?token|cloudflare[_-]?api[_-]?(?:key|token)|signed[_-]?urls?|presigned[_-]?urls?|sas[_-]?tokens?|dockerconfigjson|signature|sig)(?:$|[_.-])"
)
STRICT_FIELD = (
    r"(?i)(?:^|[_.-])(?:api[_-]?keys?|client[_-]?secrets?|secrets?|passwords?|passwd|pwd|access[_-]?tokens?|refresh[_-]?tokens?|id[_-]?tokens?|auth[_-]?tokens?|"
    r"session[_-]?tokens?|private[_-]?keys?|secret[_-]?(?:access[_-]?)?keys?|access[_-]?keys?|account[_-]?keys?|signing[_-]?keys?|encryption[_-]?keys?|credentials?|authorization)$"
)
FOLDED = ("İıſK", "iisk")


def folded(text: Column) -> Column:
    """Lower case, with the four characters that match i, s and k when case is ignored."""
    return F.lower(F.translate(text, *FOLDED))


def may_match(text: Column, rule: Rule) -> Column:
    """A cheap condition that every text with a match meets."""
    if rule.literal:
        return F.contains(text, F.lit(rule.literal))
    if not rule.anchors:
        return F.lit(True)
    seen = folded(text) if rule.anchor_ci else text
    out = F.contains(seen, F.lit(rule.anchors[0]))
    for a in rule.anchors[1:]:
        out = out | F.contains(seen, F.lit(a))
    return out


def mask_partial(secret: Column, placeholder: str = DEFAULT.placeholder) -> Column:
    """first4...last4:digest8; the placeholder for 12 characters or fewer."""
    digest = F.left(F.sha2(secret, 256), F.lit(8))
    return F.when(F.length(secret) <= 12, F.lit(placeholder)).otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4)), F.lit(":"), digest))


def hits(text: Column, rule: Rule) -> Column:
    if rule.literal:
        return ((F.length(text) - F.length(F.replace(text, F.lit(rule.literal), F.lit("")))) / F.lit(len(rule.literal))).cast("long")
    return F.regexp_count(text, F.lit(rule.java)).cast("long")


def substitute(text: Column, rule: Rule, policy: Policy = DEFAULT) -> Column:
    if policy.mode == "partial" and not rule.keeps_context:
        pattern = F.lit(rule.java)
        masks = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: mask_partial(m, policy.placeholder))
        return F.array_join(F.zip_with(F.split(text, rule.java, -1), masks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    if rule.literal:
        return F.replace(text, F.lit(rule.literal), F.lit(policy.placeholder))
    return F.regexp_replace(text, F.lit(rule.java), F.lit(rule.replacement(policy.placeholder, "$", "\\$")))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _any_held(rules: tuple[Rule, ...]):
    """Whether a text holds a literal of one of these rules. It is folded once."""
    plain, caseless = ([a for r in rules if r.anchor_ci is ci for a in (r.anchors or (r.literal,))] for ci in (False, True))
    held = lambda text, literals: reduce(lambda x, y: x | y, (F.contains(text, F.lit(a)) for a in literals))

    def test(text: Column) -> Column:
        low = _let(folded(text), lambda t: held(t, caseless)) if caseless else None
        return low if not plain else held(text, plain) if low is None else held(text, plain) | low

    return test


#: Rules that are passed by together where a text holds no literal of any of them. Spark resolves one more level of names for
#: each group, and gives up at about forty levels.
_GROUP = 6


def _one_rule(rule: Rule, policy: Policy):
    return lambda t: substitute(t, rule, policy)


def _chain(rules: tuple[Rule, ...], policy: Policy):
    """What these rules leave of a text, if it holds a literal of one of them."""

    def step(text: Column) -> Column:
        out = text
        for rule in rules:
            # bound to a name first where the text is used more than once, so that the expression grows by one step a rule
            out = _let(out, _one_rule(rule, policy)) if policy.mode == "partial" else substitute(out, rule, policy)
        return F.when(_any_held(rules)(text), out).otherwise(text) if all(r.anchors or r.literal for r in rules) else out

    return step


def redacted(text: Column, policy: Policy = DEFAULT) -> Column:
    """The fold as one expression, for use inside lambdas. Patterns run only in groups of rules of which a text holds a literal, and
    texts that hold none at all are passed by."""
    if not policy.fold:
        return text
    out = text
    for first in range(0, len(policy.fold), _GROUP):
        out = _let(out, _chain(policy.fold[first : first + _GROUP], policy))
    if any(not r.anchors and not r.literal for r in policy.fold):
        return out
    return F.when(_any_held(policy.fold)(text), out).otherwise(text)


def normalize_key(key: Column) -> Column:
    """Camel-case edges become underscores."""
    return F.regexp_replace(F.regexp_replace(key, r"(?<=[a-z0-9])(?=[A-Z])", "_"), r"(?<=[A-Z])(?=[A-Z][a-z])", "_")


def classify_key(key: Column) -> Column:
    """normal, sensitive or strict; null keys are normal."""
    name = normalize_key(key)
    strict, sensitive = name.rlike("(?U)" + STRICT_FIELD), name.rlike("(?U)" + SENSITIVE_FIELD)
    return F.when(sensitive & strict, "strict").when(sensitive, "sensitive").otherwise("normal")


def mask_field(value: Column, kind: str, key_class: Column, placeholder: str = DEFAULT.placeholder) -> Column:
    """The value of a field by its name's class. kind: string, boolean or number. Null stays; normal fields stay.

    Strings: blank stays; short ones (under 8 trimmed) stay unless strict. Numbers are masked if strict, booleans never.
    """
    text = value.cast("string")
    if kind == "boolean":
        return text
    strict, sensitive = key_class == "strict", key_class == "sensitive"
    if kind == "number":
        return F.when(value.isNotNull() & strict, F.lit(placeholder)).otherwise(text)
    size = F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when((size > 0) & (strict | (sensitive & (size >= 8))), F.lit(placeholder)).otherwise(text)


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def is_json(content_type: Column) -> Column:
    kind = media_type(content_type)
    return F.coalesce((kind == "application/json") | kind.endswith("+json"), F.lit(False))


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(url: Column, part: str) -> Column:
    """scheme, userinfo, host, port (as text), path, query or fragment; empty where the url has none."""
    group = {"scheme": 1, "path": 3, "query": 4, "fragment": 5}
    if part in group:
        found = F.regexp_extract(url, _URL, group[part])
        return F.lower(found) if part == "scheme" else found
    authority = F.regexp_extract(url, _URL, 2)
    if part == "userinfo":
        return F.when(F.contains(authority, F.lit("@")), F.regexp_extract(authority, r"^(.*)@[^@]*$", 1)).otherwise("")
    place = F.regexp_replace(authority, r"^.*@", "")
    if part == "host":
        return F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))
    return F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)


def effective_port(url: Column) -> Column:
    """The port, or that of the scheme; null if neither is known or the port is no number up to 65535."""
    text, scheme = url_part(url, "port"), url_part(url, "scheme")
    port = F.when(text.rlike(r"^[0-9]{1,5}$"), text.cast("int"))
    known = F.when(scheme == "http", 80).when(scheme == "https", 443)
    return F.when(port.between(1, 65535), port).when((text == "") | (port == 0), known)


def percent_decoded(text: Column) -> Column:
    """Each good escape decoded, bad ones as they are; bytes that are no UTF-8 become the replacement character. Null stays null."""
    parts = F.split(text, "%", -1)
    escaped = lambda p: p.rlike(r"^[0-9A-Fa-f]{2}")
    first = F.hex(F.encode(F.get(parts, F.lit(0)), "UTF-8"))
    rest = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.when(escaped(p), F.concat(F.upper(F.left(p, F.lit(2))), F.hex(F.encode(F.substr(p, F.lit(3)), "UTF-8")))).otherwise(F.concat(F.lit("25"), F.hex(F.encode(p, "UTF-8")))),
    )
    return F.when(F.contains(text, F.lit("%")), F.make_valid_utf8(F.unhex(F.concat(first, F.array_join(rest, ""))).cast("string"))).otherwise(text)


def normalize_path(path: Column) -> Column:
    """Percent-decoded, with empty and dot segments resolved; begins with one slash. Bad escapes stay as they are."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(percent_decoded(path), "/"),
        none,
        lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def join_target(base: Column, path: Column) -> Column:
    """base and path as one url: a path that begins with the base's path, or with its last segment, does not repeat it."""
    trimmed = F.regexp_replace(base, "/+$", "")
    origin = F.regexp_extract(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    root = F.regexp_replace(url_part(trimmed, "path"), "/+$", "")
    incoming = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    tail = F.concat(F.lit("/"), F.substring_index(root, "/", -1))
    under = lambda start: (incoming == start) | F.startswith(incoming, F.concat(start, F.lit("/")))
    final = (
        F.when((root == "") | under(root), incoming)
        .when(under(tail), F.concat(root, F.substr(incoming, F.length(tail) + 1)))
        .otherwise(F.concat(root, incoming))
    )
    return F.concat(origin, final)


def usage_normalize(usage: Column) -> Column:
    """input_tokens, output_tokens and total_tokens of a usage struct; zero counts as missing."""
    some = lambda *names: F.coalesce(*(F.nullif(usage[n].cast("long"), F.lit(0)) for n in names), F.lit(0).cast("long"))
    given, made = some("prompt_tokens", "input_tokens"), some("completion_tokens", "output_tokens")
    total = F.coalesce(F.nullif(usage["total_tokens"].cast("long"), F.lit(0)), given + made)
    return F.when(usage.isNotNull(), F.struct(given.alias("input_tokens"), made.alias("output_tokens"), total.alias("total_tokens")))


def encrypt_value(value: Column, key: Column) -> Column:
    """AES-GCM, url-safe base64 of nonce and ciphertext. The key is never logged."""
    return F.translate(F.base64(F.aes_encrypt(value, key, F.lit("GCM"))), "+/", "-_")


def decrypt_value(sealed: Column, key: Column) -> Column:
    """The inverse; null where the value or key is wrong."""
    return F.try_aes_decrypt(F.unbase64(F.translate(sealed, "-_", "+/")), key, F.lit("GCM")).cast("string")
