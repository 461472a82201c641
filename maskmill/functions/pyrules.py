"""The same rules by Python's re, for what is dynamic: free-form JSON and bytes. Small helpers inside Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter

from .columns import FOLDED, SENSITIVE_FIELD, STRICT_FIELD
from .rules import Policy


#: The four characters that match i, s and k when case is ignored.
_FOLD = str.maketrans(*FOLDED)
#: What is left of a name behind a literal in it, and the sign before the name's value, if there is one; of a folded text.
_NAME_END = re.compile(r"[a-z0-9_.-]*\s*([:=])?")
_compact = json.JSONEncoder(separators=(",", ":")).encode


def _folded(value: str) -> str:
    """The text in lower case, those characters as what they match. Few texts hold one, and looking for them is much cheaper."""
    if not value.isascii() and any(c in value for c in FOLDED[0]):
        value = value.translate(_FOLD)
    return value.lower()


def _assigned(low: str, literal: str) -> bool:
    """Whether a folded text assigns something to a name that holds the literal. Linear: no part of a name is looked at twice."""
    at = low.find(literal)
    while at >= 0:
        name = _NAME_END.match(low, at + len(literal))
        if name[1]:
            return True
        at = low.find(literal, name.end())
    return False


class KeyCollision(ValueError):
    """Two keys of one mapping become equal."""


class Redactor:
    def __init__(self, policy: Policy):
        self.policy = policy
        self.rules = [(r, re.compile(r.pattern)) for r in policy.fold]
        self.sensitive, self.strict = re.compile(SENSITIVE_FIELD), re.compile(STRICT_FIELD)
        self._keys: dict[str, tuple[str, Counter, str]] = {}
        self._texts: dict[str, tuple[str, Counter]] = {}
        # (place in the fold, literal) of what a text must hold for a rule to match; rules without a literal are tried on every text
        held = [(i, a, r.anchor_ci) for i, (r, _) in enumerate(self.rules) for a in (r.anchors or ((r.literal,) if r.literal else ()))]
        self._plain, self._caseless = ([(i, a) for i, a, ci in held if ci is which] for which in (False, True))
        self._always = set(range(len(self.rules))) - {i for i, _, _ in held}

    def _tried(self, value: str, first: int) -> list[int]:
        """The places, from first on, of the rules that may match: those of which the text holds a literal, and those in any case only
        if it is in a name that gets a value. (The placeholder holds one too, and their patterns are slow on a whole text.)"""
        low = _folded(value) if self._caseless else ""
        found = {i for i, a in self._plain if i >= first and a in value} | {i for i, a in self._caseless if i >= first and _assigned(low, a)}
        return sorted(found | {i for i in self._always if i >= first})

    def spans(self, value: str) -> list[tuple[int, int, int]]:
        """(rule's place in the fold, start, end) of what each rule would mask in the text as it is, in fold order."""
        plain = _folded(value)
        out = []
        for i, (rule, pattern) in enumerate(self.rules):
            if not rule.anchors or any(a in (plain if rule.anchor_ci else value) for a in rule.anchors):
                ends = ((m.end(rule.before[-1]) if rule.before else m.start(), m.start(rule.after[0]) if rule.after else m.end()) for m in pattern.finditer(value))
                out += [(i, a, b) for a, b in ends if b > a]
        return out

    def text(self, value: str, hits: Counter) -> str:
        todo = self._tried(value, 0)
        while todo:
            at = todo.pop(0)
            rule, pattern = self.rules[at]
            value, n = pattern.subn(lambda m, rule=rule: self._mask(rule, m), value)
            if n:
                hits[rule.name] += n
                todo = self._tried(value, at + 1)
        return value

    def short(self, value: str, hits: Counter) -> str:
        """text of a short value. The same ones come again in every payload (roles, models, types): some thousand are remembered."""
        known = self._texts.get(value)
        if known is None:
            own: Counter = Counter()
            known = (self.text(value, own), own)
            if len(self._texts) >= 4096:
                self._texts.clear()
            self._texts[value] = known
        if known[1]:
            hits.update(known[1])
        return known[0]

    def _mask(self, rule, m: re.Match) -> str:
        secret, mark = m[0], self.policy.placeholder
        if rule.keeps_context:
            return "".join(m[g] for g in rule.before) + mark + "".join(m[g] for g in rule.after)
        if self.policy.mode == "full" or len(secret) <= 12:
            return mark
        return f"{secret[:4]}...{secret[-4:]}:{hashlib.sha256(secret.encode()).hexdigest()[:8]}"

    def key_class(self, key: str) -> str:
        name = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key))
        if not self.sensitive.search(name):
            return "normal"
        return "strict" if self.strict.search(name) else "sensitive"

    def _key(self, key: str) -> tuple[str, Counter, str]:
        """(redacted key, its hits, its class). The same keys come again in every payload: some thousand are remembered."""
        known = self._keys.get(key)
        if known is None:
            hits: Counter = Counter()
            known = (self.text(key, hits), hits, self.key_class(key))
            if len(self._keys) >= 4096:
                self._keys.clear()
            if len(key) <= 256:
                self._keys[key] = known
        return known

    def tree(self, value, hits: Counter, under: str = "normal"):
        """A parsed JSON value. under: the class of the outermost sensitive key above it."""
        if isinstance(value, list):
            return [self.tree(x, hits, under) for x in value]
        if isinstance(value, dict):
            out: dict = {}
            for key, item in value.items():
                name, found, kind = self._key(key)
                if found:
                    hits.update(found)
                if name in out:
                    raise KeyCollision
                out[name] = self.tree(item, hits, kind if under == "normal" else under)
            return out
        if under == "normal":
            if not isinstance(value, str):
                return value
            return self.short(value, hits) if len(value) <= 24 else self.text(value, hits)
        size = len(value.strip()) if isinstance(value, str) else None
        hide = size > 0 and (under == "strict" or size >= 8) if size is not None else under == "strict" and value is not None and not isinstance(value, bool)
        if hide:
            hits["sensitive_field"] += 1
        return self.policy.placeholder if hide else value

    def json(self, body: str) -> tuple[str | None, Counter, str | None]:
        """(compact JSON or None, hits, why it is rejected)."""
        hits: Counter = Counter()
        try:
            value = json.loads(body)
        except ValueError:
            return None, hits, "malformed"
        if not self.policy.enabled:
            return body, hits, None
        try:
            return _compact(self.tree(value, hits)), hits, None
        except KeyCollision:
            return None, Counter(), "colliding keys"
        except RecursionError:
            return None, Counter(), "too deep"

    def parts(self, body: str, named: bool = False) -> tuple[str | None, Counter, str | None]:
        """json of a list's items (messages), or of a mapping's values (call parameters), whose own names are not classified."""
        hits: Counter = Counter()
        try:
            value = json.loads(body)
        except ValueError:
            return None, hits, "malformed"
        if not isinstance(value, dict if named else list):
            return None, hits, "not a mapping" if named else "not a list"
        if not self.policy.enabled:
            return body, hits, None
        try:
            done = {k: self.tree(v, hits) for k, v in value.items()} if named else self.tree(value, hits)
        except KeyCollision:
            return None, Counter(), "colliding keys"
        except RecursionError:
            return None, Counter(), "too deep"
        return _compact(done), hits, None

    def data(self, body: bytes) -> tuple[bytes, Counter]:
        """Bytes that are not UTF-8 survive."""
        hits: Counter = Counter()
        return self.text(body.decode("utf-8", "surrogateescape"), hits).encode("utf-8", "surrogateescape"), hits
