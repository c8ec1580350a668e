"""The filter language: boolean combinations of equality and presence, read once on the driver into one Column.

``(&(type=skill)(tag=pdf)(!(env=dev)))``: ``&`` and ``|`` take one or more filters, ``!`` one; ``(key=value)`` is
equality, ``(key=*)`` presence. Within values ``\\ * ( )`` are written with a backslash before them."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from ..schema import TOP_COLUMNS

#: Fixed by the grammar: characters of a key, escapes of a value, blanks.
_KEY = re.compile(r"[A-Za-z0-9_.:/-]+")
_VALUE = re.compile(r"(?:[^()\\]|\\[\\*()])*")
_BLANK = " \t\r\n"
_SPACE = re.compile(rf"[{_BLANK}]*")
_INTEGER = re.compile(r"-?[0-9]+")


class InvalidFilterError(ValueError):
    """A filter text that can't be read; ``position`` is where, from 0."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} (at {position})")
        self.position = position


def eq_column(field: str, value: str) -> Column:
    """A column equals a value; null and the empty text equal nothing."""
    return F.coalesce((F.col(field) == F.lit(value)) & F.lit(value != ""), F.lit(False))


def eq_rev(value: str, position: int = 0) -> Column:
    """Integers as they compare, whatever their zeros; one that no revision can have equals none."""
    digits = value.strip(_BLANK)
    if not _INTEGER.fullmatch(digits):
        raise InvalidFilterError("rev needs an integer", position)
    sign, digits = digits[0] == "-", digits.lstrip("-0") or "0"
    if len(digits) > 10 or int(digits) >= 1 << 31:
        return F.lit(False)
    return F.coalesce(F.col("rev") == F.lit(-int(digits) if sign else int(digits)), F.lit(False))


def eq_attr(key: str, value: str) -> Column:
    """One of the values of an attribute."""
    return F.coalesce(F.array_contains(F.col("attrs")[key], F.lit(value)), F.lit(False))


def has_column(field: str) -> Column:
    return F.lit(True) if field == "rev" else F.coalesce(F.col(field) != "", F.lit(False))


def has_attr(key: str) -> Column:
    """The key exists, be it with no values."""
    return F.coalesce(F.map_contains_key("attrs", F.lit(key)), F.lit(False))


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts)


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts)


def resolve(key: str, position: int = 0) -> tuple[str, str]:
    """('top' or 'attr', name) that a filter key stands for."""
    if key.startswith("attrs."):
        if key == "attrs.":
            raise InvalidFilterError("attribute name is empty", position)
        return "attr", key[len("attrs.") :]
    return ("top" if key in TOP_COLUMNS else "attr"), key


class Leaf(tuple):
    """(kind, scope, key, value, position): kind ``eq`` or ``present``; value is empty for presence."""


def leaf_column(leaf: Leaf) -> Column:
    kind, scope, key, value, position = leaf
    if scope == "attr":
        return has_attr(key) if kind == "present" else eq_attr(key, value)
    if kind == "present":
        return has_column(key)
    return eq_rev(value, position) if key == "rev" else eq_column(key, value)


class _Text:
    def __init__(self, text: str, leaf):
        self.text, self.at, self.leaf = text, 0, leaf

    def blank(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def need(self, char: str) -> None:
        self.blank()
        if not self.text.startswith(char, self.at):
            raise InvalidFilterError(f"expected {char!r}", self.at)
        self.at += 1

    def peek(self) -> str:
        self.blank()
        return self.text[self.at : self.at + 1]

    def node(self) -> Column:
        self.need("(")
        mark = self.peek()
        if mark in ("&", "|"):
            self.at += 1
            parts = []
            while self.peek() == "(":
                parts.append(self.node())
            if not parts:
                raise InvalidFilterError("expected at least one filter", self.at)
            out = all_of(parts) if mark == "&" else any_of(parts)
        elif mark == "!":
            self.at += 1
            out = ~self.node()
        else:
            out = self.item()
        self.need(")")
        return out

    def item(self) -> Column:
        start = self.at
        key = _KEY.match(self.text, self.at)
        if not key:
            raise InvalidFilterError("expected a key", self.at)
        self.at = key.end()
        self.need("=")
        self.blank()
        begin, found = self.at, _VALUE.match(self.text, self.at)
        self.at = found.end()
        if self.at < len(self.text) and self.text[self.at] != ")":
            raise InvalidFilterError("unescaped parenthesis or unknown escape", self.at)
        raw = found[0].rstrip(_BLANK) if not re.search(rf"\\[{_BLANK}]*$", found[0]) else found[0]
        if self.at == len(self.text) and begin == self.at:
            raise InvalidFilterError("expected a value", self.at)
        scope, name = resolve(key[0], start)
        if raw == "*":
            return self.leaf(Leaf(("present", scope, name, "", start)))
        return self.leaf(Leaf(("eq", scope, name, re.sub(r"\\(.)", r"\1", raw), begin)))


def read_filter(text: str, leaf=leaf_column) -> Column:
    """The Column of a filter text; ``leaf`` turns each :class:`Leaf` into a Column."""
    reader = _Text(text, leaf)
    out = reader.node()
    reader.blank()
    if reader.at != len(text):
        raise InvalidFilterError("text after the filter", reader.at)
    return out


def filter_expr(text: str) -> Column:
    """Two-valued: null columns make a comparison false, and its negation true."""
    return read_filter(text)


def filter_leaves(text: str) -> list[Leaf]:
    found: list[Leaf] = []

    def keep(leaf: Leaf) -> Column:
        leaf_column(leaf)  # raises what filter_expr would
        found.append(leaf)
        return F.lit(True)

    read_filter(text, keep)
    return found


def text_match(q: str | None) -> Column:
    """Literal, case-blind: in the name or the description. Blank: everything."""
    q = (q or "").strip().lower()
    if not q:
        return F.lit(True)
    return F.coalesce(F.lower("name").contains(q), F.lit(False)) | F.coalesce(F.lower("description").contains(q), F.lit(False))


def after_cursor(updated_at, id_: str) -> Column:
    """Strictly behind (updated_at, id) when both descend."""
    at = updated_at if isinstance(updated_at, Column) else F.lit(updated_at).cast("timestamp")
    return (F.col("updated_at") < at) | ((F.col("updated_at") == at) & (F.col("id") < F.lit(id_)))


def after_seq(since: int) -> Column:
    return F.col("seq") > F.lit(since)
