"""The property filter language, compiled to a Column.

    expr   := and ("||" and)*            and   := unary ("&&" unary)*
    unary  := "!(" expr ")" | "(" expr ")" | "has?" key | key test
    test   := (= != < <= > >=) value | "in" "[" value ("," value)* ","? "]" | "like" string
    key    := word | string              value := string | number | true | false | word

Words are letters, digits and "_" of any script; strings stand between ' or " and have no
escapes. "in" and "like" need no word end after them; what follows is read as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import props


class FilterError(ValueError):
    pass


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str):
        raise FilterError(f"{what} at position {self.at} of {self.text!r}")

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, token: str) -> bool:
        self.space()
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            self.fail(f"expected {token!r}")

    def run(self, ok: Callable[[str], bool]) -> str:
        start = self.at
        while self.at < len(self.text) and ok(self.text[self.at]):
            self.at += 1
        return self.text[start : self.at]

    def string(self) -> str:
        quote = self.peek()
        if not quote:
            self.fail("expected a string")
        end = self.text.find(quote, self.at + 1)
        if end < 0:
            self.fail("unterminated string")
        out, self.at = self.text[self.at + 1 : end], end + 1
        return out

    def word(self) -> str:
        return self.run(lambda c: c.isalnum() or c == "_")

    def key(self) -> str:
        self.space()
        if self.peek() in ("'", '"'):
            return self.string()
        c = self.peek()
        if c.isnumeric() or c == "-":
            self.fail("a number is no key")
        out = self.word()
        if not out or out in ("true", "false"):
            self.fail("expected a key")
        return out

    def value(self):
        self.space()
        c = self.peek()
        if c in ("'", '"') and c:
            return self.string()
        if c and (c.isnumeric() or c == "-"):
            got = self.run(lambda x: x.isnumeric() or x in ".-")
            if not re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", got) or not got.isascii():
                self.fail(f"not a number: {got!r}")
            return float(got)
        got = self.word()
        if not got:
            self.fail("expected a value")
        return {"true": True, "false": False}.get(got, got)


def parse(text: str) -> tuple:
    """The expression as nested tuples: ("or"|"and", a, b), ("not", a), ("has", key), ("in", key, values), ("like", key, pattern), (op, key, value)."""
    r = _Reader(text)
    out = _any(r)
    r.space()
    if r.at < len(text):
        r.fail("unexpected text")
    return out


def _chain(r: _Reader, token: str, name: str, inner) -> tuple:
    out = inner(r)
    while r.take(token):
        out = (name, out, inner(r))
    return out


def _any(r: _Reader) -> tuple:
    return _chain(r, "||", "or", _all)


def _all(r: _Reader) -> tuple:
    return _chain(r, "&&", "and", _unary)


def _unary(r: _Reader) -> tuple:
    if r.take("!"):
        r.need("(")
        out = ("not", _any(r))
        r.need(")")
        return out
    if r.take("("):
        out = _any(r)
        r.need(")")
        return out
    if r.take("has?"):
        return ("has", r.key())
    key = r.key()
    for op in ("<=", ">=", "!=", "<", ">", "="):
        if r.take(op):
            return (op, key, r.value())
    if r.take("in"):
        r.need("[")
        values = [r.value()]
        while r.take(","):
            if r.peek() == "]":
                break
            values.append(r.value())
        r.need("]")
        return ("in", key, values)
    if r.take("like"):
        r.space()
        return ("like", key, r.string())
    r.fail("expected a comparison")


def column(node: tuple, properties: Column) -> Column:
    """The predicate over a VARIANT column; literals are bound, never spliced into SQL."""
    op = node[0]
    if op in ("or", "and"):
        a, b = column(node[1], properties), column(node[2], properties)
        return a | b if op == "or" else a & b
    if op == "not":
        return ~column(node[1], properties)
    v = props.get(properties, node[1])
    if op == "has":
        return props.has(v)
    if op == "in":
        return props.among(v, node[2])
    if op == "like":
        return props.like(v, node[2])
    if op == "!=":
        return props.differs(v, node[2])
    return props.compare(v, op, node[2])


def implied(node: tuple, hot: Column, keys: tuple[str, ...]) -> Column | None:
    """What a match says of the typed copies of some keys (hot.key.text, hot.key.number), for scans to skip by; None if it says nothing. It holds wherever the predicate does, not the other way round."""
    op = node[0]
    if op in ("or", "and"):
        a, b = implied(node[1], hot, keys), implied(node[2], hot, keys)
        if a is None or b is None:
            return None if op == "or" else b if a is None else a
        return a | b if op == "or" else a & b
    if op in ("not", "!=") or node[1] not in keys:
        return None
    text, number = hot[node[1]]["text"], hot[node[1]]["number"]
    if op in ("has", "like"):
        return text.isNotNull() | number.isNotNull()
    if op == "in":
        texts, numbers = [x for x in node[2] if isinstance(x, str)], [float(x) for x in node[2] if not isinstance(x, str)]
        parts = [c.isin(x) for c, x in ((text, texts), (number, numbers)) if x]
        return parts[0] | parts[1] if len(parts) > 1 else parts[0]
    # any number is below any text
    own, other, value = (text, number, F.lit(node[2])) if isinstance(node[2], str) else (number, text, F.lit(float(node[2])))
    test = {"=": own.__eq__, "<": own.__lt__, "<=": own.__le__, ">": own.__gt__, ">=": own.__ge__}[op](value)
    crosses = op in ("<", "<=") if isinstance(node[2], str) else op in (">", ">=")
    return test | other.isNotNull() if crosses else test


def predicate(properties: Column, start: Column, filter: str | None = None, before: date | None = None, after: date | None = None) -> Column:
    """All conditions of a listing; dates mean midnight UTC and are strict, a missing start time never matches one."""
    out = F.lit(True)
    if before is not None:
        out = out & (start < F.lit(before.isoformat()).cast("timestamp"))
    if after is not None:
        out = out & (start > F.lit(after.isoformat()).cast("timestamp"))
    if filter:
        out = out & column(parse(filter), properties)
    return out
