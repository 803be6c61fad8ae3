"""Settings of a run: a base, overrides by dotted name, and references between them."""

from __future__ import annotations

import json
import re
from copy import deepcopy

_REFERENCE = re.compile(r"\$\{([^${}]+)\}")


def _value(text: str):
    """A number, true, false, null or JSON as such, anything else as text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def _at(settings: dict, name: str):
    found = settings
    for part in name.split("."):
        found = found[part]
    return found


def merge(base: dict, overrides: list[str]) -> dict:
    """base with each `a.b=value` set, then every ${a.b} replaced by the value of that name.

    A reference that is the whole text keeps its value's type. An unknown name is a KeyError, a circle a ValueError.
    """
    out = deepcopy(base)
    for one in overrides:
        name, _, text = one.partition("=")
        *path, last = name.split(".")
        at = out
        for part in path:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = _value(text)

    def resolved(value, seen: tuple[str, ...] = ()):
        if isinstance(value, dict):
            return {k: resolved(v, seen) for k, v in value.items()}
        if isinstance(value, list):
            return [resolved(v, seen) for v in value]
        if not isinstance(value, str):
            return value

        def of(name: str):
            if name in seen:
                raise ValueError(f"{name} refers to itself")
            return resolved(_at(out, name), (*seen, name))

        whole = _REFERENCE.fullmatch(value)
        return of(whole[1]) if whole else _REFERENCE.sub(lambda m: str(of(m[1])), value)

    return resolved(out)
