"""JSON that keeps numbers exact, and its canonical bytes and hashes."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

from claimloom.functions import exact

#: Short escapes of the canonical form; other controls are \u00xx.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def _no(text: str):
    raise ValueError(f"not JSON: {text}")


def loads(text: str | bytes):
    """Strict JSON: exact numbers, no duplicate keys, no NaN, valid Unicode."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    value = json.loads(text.removeprefix("\ufeff"), object_pairs_hook=_object, parse_float=exact.parse, parse_int=exact.parse, parse_constant=_no)
    _check(value)
    return value


def _check(value) -> None:
    if isinstance(value, str):
        value.encode("utf-8")  # a lone surrogate is no text
    elif isinstance(value, list):
        for v in value:
            _check(v)
    elif isinstance(value, dict):
        for k, v in value.items():
            _check(k)
            _check(v)


def _string(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


def dumps(value) -> str:
    """The canonical form: keys in order of code points, no white space, plain numbers."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, Decimal)):
        return exact.token(Decimal(value))
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(dumps, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{_string(k)}:{dumps(value[k])}" for k in sorted(value)) + "}"
    raise TypeError(f"no canonical form of {type(value).__name__}")


def digest(value, domain: str | None = None, version: str = "canonical/v1") -> str:
    """sha256: of the canonical bytes; with a domain, of an envelope that keeps domains apart."""
    if domain is not None:
        value = {"domain": domain, "version": version, "payload": value}
    return "sha256:" + hashlib.sha256(dumps(value).encode()).hexdigest()


class Root:
    """A digest over an ordered stream of digests."""

    def __init__(self, name: str):
        self.name, self.hashes = name, []

    def push(self, value) -> str:
        self.hashes.append(digest({"index": len(self.hashes), "value": value}, f"{self.name}.item"))
        return self.hashes[-1]

    def root(self) -> str:
        return digest(self.hashes, f"{self.name}.root")


def closed(value: dict, required: set[str], optional: set[str] = frozenset()) -> dict:
    """value, if it is an object with all required keys and no unknown ones."""
    if not isinstance(value, dict) or required - value.keys() or value.keys() - required - optional:
        raise ValueError("object of another shape")
    return value
