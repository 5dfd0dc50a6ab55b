"""JSON text beyond what a fixed schema reads: strict parsing without a depth limit, wrapped JSON, canonical values.

Only RFC 8259 JSON counts as JSON, so NaN and Infinity do not. A string that itself holds a JSON object or array counts as
that value wherever an object or array may stand.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from json.decoder import scanstring
from typing import Any

INVALID = object()
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _float(text: str) -> Any:
    """A number by value: whole numbers as int, others as the shortest decimal, tagged so that they differ from strings."""
    value = Decimal(text)
    if not value:
        return 0
    sign, digits, exponent = value.as_tuple()
    figures = "".join(map(str, digits))
    short = figures.rstrip("0")
    exponent += len(figures) - len(short)
    if 0 <= exponent <= 400:
        return int(("-" if sign else "") + short + "0" * exponent)
    return {"number": f"{'-' * sign}{short.lstrip('0') or '0'}e{exponent}"}


def _int(text: str) -> Any:
    return int(text) if len(text) < 400 else _float(text)


def _reject(word: str) -> None:
    raise ValueError(word)


_exact = json.JSONDecoder(parse_float=_float, parse_int=_int, parse_constant=_reject)
_plain = json.JSONDecoder(parse_constant=_reject, parse_int=_int)


def _iterative(text: str, exact: bool) -> Any:
    """The same language as the decoder's, with its own stack instead of recursion."""
    stack: list[tuple[Any, str | None]] = []
    at = _SPACE.match(text, 0).end()
    root: Any = INVALID
    while True:
        # A value starts at ``at``.
        c = text[at : at + 1]
        opened = False
        if c == "{" or c == "[":
            value: Any = {} if c == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            else:
                opened = True
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            token, at = m.group(), m.end()
            value = (_float(token) if exact else float(token)) if re.search("[.eE]", token) else _int(token)
        else:
            for word, value in _WORDS.items():
                if text.startswith(word, at):
                    at += len(word)
                    break
            else:
                raise ValueError(at)
        if opened:
            stack.append((value, None))
        while not opened:
            if not stack:
                root = value
                break
            box, key = stack[-1]
            box.append(value) if key is None else box.__setitem__(key, value)
            at = _SPACE.match(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                break
            if c != ("]" if isinstance(box, list) else "}"):
                raise ValueError(at)
            at += 1
            value = box
            stack.pop()
        if not stack and root is not INVALID:
            if _SPACE.match(text, at).end() != len(text):
                raise ValueError(at)
            return root
        if isinstance(stack[-1][0], dict):
            if text[at : at + 1] != '"':
                raise ValueError(at)
            key, at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(at)
            at = _SPACE.match(text, at + 1).end()
            stack[-1] = (stack[-1][0], key)


def parse(text: str | None, exact: bool = False) -> Any:
    """The value, or INVALID for null and for text that is not JSON. ``exact`` compares numbers by value."""
    if text is None:
        return INVALID
    try:
        return (_exact if exact else _plain).decode(text)
    except RecursionError:
        try:
            return _iterative(text, exact)
        except (ValueError, ArithmeticError):
            return INVALID
    except (ValueError, ArithmeticError):
        return INVALID


def unwrap(value: Any, exact: bool = False) -> Any:
    """A string that holds a JSON object or array, however often wrapped, as that value; anything else as it is."""
    seen = value
    while isinstance(seen, str):
        seen = parse(seen, exact)
    return seen if isinstance(seen, (dict, list)) else value


def member(value: Any, key: str) -> Any:
    """A field of an object; null where there is no object or no such field."""
    return value.get(key) if isinstance(value, dict) else None


def elements(value: Any) -> list:
    """The elements of an array, also of one wrapped in a string; none for anything else."""
    value = unwrap(value)
    return value if isinstance(value, list) else []


def text_or_empty(value: Any) -> str:
    """A string as it is; the empty string for a missing id or one of another type."""
    return value if isinstance(value, str) else ""
