"""CSS selectors as text, compiled to the step tuples that ``htmltree`` matches.

Understood: type and universal selectors, ``.class``, ``#id``, ``[a]``,
``[a=v]``, ``[a*=v]``, ``[a^=v]``, ``[a$=v]``, ``[a~=v]`` (values quoted or
bare), descendant and child combinators, and groups. Anything else is an error,
so that a selector never silently matches something other than it says.
"""

from __future__ import annotations

import re
from functools import lru_cache

_NAME = r"-?[_a-zA-Z\u0080-\U0010FFFF][-\w]*"
_TOKEN = re.compile(
    rf"(?P<type>\*|{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>[-\w]+)"
    rf"|\[\s*(?P<attr>[-\w:]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[-\w]+))\s*)?\]"
    r"|(?P<child>\s*>\s*)|(?P<group>\s*,\s*)|(?P<space>\s+)")
#: Marks a step whose element stands directly below that of the step before.
CHILD = ("child",)


def _condition(m: re.Match) -> tuple | None:
    if m["type"]:
        return None if m["type"] == "*" else ("tag", m["type"].lower())
    if m["cls"]:
        return ("class", m["cls"])
    if m["id"]:
        return ("attr", "id", m["id"])
    name = m["attr"].lower()
    if not m["op"]:
        return ("has", name)
    value = next(v for v in (m["dq"], m["sq"], m["bare"]) if v is not None)
    return ("attr" if m["op"] == "=" else f"attr{m['op'][0]}", name, value)


@lru_cache(maxsize=1024)
def _compiled(text: str) -> tuple:
    group: list[tuple] = []
    steps: list[tuple] = []
    current: list[tuple] | None = None
    at, css = 0, text.strip()
    if not css:
        raise ValueError("an empty selector")

    def close(what: str) -> None:
        nonlocal current
        if current is None:
            raise ValueError(f"{what} without a selector before it: {text!r}")
        steps.append(tuple(current))
        current = None

    start: list[tuple] = []
    while at < len(css):
        m = _TOKEN.match(css, at)
        if not m:
            raise ValueError(f"not a known selector at {css[at:]!r}: {text!r}")
        kind = m.lastgroup if m.lastgroup in ("child", "group", "space") else "part"
        if kind == "part":
            if current is None:
                current, start = list(start), []
            elif m["type"]:
                raise ValueError(f"a type after other conditions at {css[at:]!r}: {text!r}")
            condition = _condition(m)
            current += [condition] if condition else []
        else:
            close("a combinator")
            if kind == "child":
                start = [CHILD]
            elif kind == "group":
                group.append(tuple(steps))
                steps = []
        at = m.end()
    close("an end")
    group.append(tuple(steps))
    return tuple(group)


def compile_group(text: str) -> list[list[tuple]]:
    """The selectors of a group, each a list of steps."""
    return [list(steps) for steps in _compiled(text)]


def compile_list(texts: list[str]) -> list[list[tuple]]:
    """One selector per text, in order."""
    out = []
    for text in texts:
        group = compile_group(text)
        if len(group) != 1:
            raise ValueError(f"one selector, not a group: {text!r}")
        out += group
    return out


def compile_steps_of(text: str) -> list[tuple]:
    """The steps of a group whose selectors have no combinators."""
    group = compile_group(text)
    if any(len(steps) != 1 for steps in group):
        raise ValueError(f"combinators in {text!r}")
    return [steps[0] for steps in group]
