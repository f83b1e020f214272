"""JSON path notation: steps, normal form, parents."""

from __future__ import annotations

import re
from functools import lru_cache

_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_STEP = re.compile(
    r"""\.(?P<dot>[^.\[\]]+)             # .name
      | \[\s*'(?P<single>(?:[^'\\]|\\.)*)'\s*\]
      | \[\s*"(?P<double>(?:[^"\\]|\\.)*)"\s*\]
      | \[\s*(?P<any>\*)\s*\]
      | \[\s*(?P<pos>\d+)\s*\]
    """,
    re.VERBOSE | re.DOTALL,
)
_UNESCAPE = {"n": "\n", "r": "\r", "t": "\t"}
_ESCAPE = str.maketrans({"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t"})


@lru_cache(maxsize=100_000)
def name_step(name: str) -> str:
    """``.name`` for an identifier, ``['name']`` otherwise."""
    return f".{name}" if _IDENT.match(name) else f"['{name.translate(_ESCAPE)}']"


def bracket_name(raw: str) -> str:
    """The name written between the quotes of a bracket."""
    return re.sub(r"\\(.)", lambda e: _UNESCAPE.get(e[1], e[1]), raw, flags=re.DOTALL)


@lru_cache(maxsize=200_000)
def normal_steps(path: str) -> tuple[str, ...]:
    """The steps of a path in normal form; text that is no path is kept as one step."""
    text = path.strip()
    at = 1 if text.startswith("$") else 0
    if at == 0 and text and text[0] not in ".[":
        text = "." + text
    steps = []
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            return (name_step(path),)
        if (name := m["dot"]) is not None:
            steps.append(name_step(name))
        elif m["any"]:
            steps.append("[*]")
        elif m["pos"] is not None:
            steps.append(f"[{int(m['pos'])}]")
        else:
            raw = m["single"] if m["single"] is not None else m["double"]
            steps.append(name_step(bracket_name(raw)))
        at = m.end()
    return tuple(steps)


def show(steps: tuple[str, ...]) -> str:
    return "$" + "".join(steps)
