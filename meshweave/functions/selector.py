"""The selection language: infix text to a boolean column.

Operands: group names and attribute numbers; all[], no_group[], range[a, b], normal[x, y, z, eps], plane[...], box[...],
cylinder[...], sphere[...]; comparisons of x, y, z. Operators: not ! !=, and & &&, or | || , ;, xor ^, parentheses.
A quoted or backslash-escaped name is a name whatever it spells.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words and signs of each operator, and how tightly it binds.
OPERATORS = {"not": ("not", 3), "!": ("not", 3), "!=": ("not", 3), "and": ("and", 2), "&": ("and", 2), "&&": ("and", 2), "or": ("or", 1), "|": ("or", 1), "||": ("or", 1), ",": ("or", 1), ";": ("or", 1), "xor": ("xor", 1), "^": ("xor", 1)}
FUNCTIONS = ("all", "no_group", "range", "normal", "plane", "box", "cylinder", "sphere")
TOKEN = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(<=|>=|&&|\|\||!=|[()\[\],;&|^!<>])|((?:\\.|[^\s()\[\],;&|^!<>"'\\])+))""")


class SelectionError(ValueError):
    """A text that is no selection."""


@dataclass
class Selection:
    """A parsed selection: its condition and what it needs."""

    condition: Column
    names: set[str] = field(default_factory=set)
    attributes: set[int] = field(default_factory=set)
    needs_coordinates: bool = False
    needs_normals: bool = False


def tokens(text: str) -> list[tuple[str, bool]]:
    """(token, protected): protected ones are names whatever they look like."""
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise SelectionError(f"cannot read: {text[at:]!r}")
        quoted = m[1] if m[1] is not None else m[2]
        if quoted is not None:
            out.append((re.sub(r"\\(.)", r"\1", quoted), True))
        elif m[3]:
            out.append((m[3], False))
        else:
            out.append((re.sub(r"\\(.)", r"\1", m[4]), "\\" in m[4]))
        at = m.end()
    return out


class Parser:
    """Recursive descent over the three strengths of binding."""

    def __init__(self, text: str):
        self.left, self.made = tokens(text), Selection(F.lit(True))

    def peek(self) -> tuple[str, bool]:
        return self.left[0] if self.left else ("", True)

    def take(self, wanted: str | None = None) -> str:
        if not self.left or (wanted and self.left[0] != (wanted, False)):
            raise SelectionError(f"expected {wanted or 'more'}, found {self.peek()[0] or 'the end'!r}")
        return self.left.pop(0)[0]

    def operator(self, strength: int) -> str | None:
        word, protected = self.peek()
        known = OPERATORS.get(word.lower())
        return known[0] if known and not protected and known[1] == strength else None

    def whole(self) -> Selection:
        self.made.condition = self.either()
        if self.left:
            raise SelectionError(f"left over: {self.peek()[0]!r}")
        return self.made

    def either(self) -> Column:
        out = self.both()
        while op := self.operator(1):
            self.take()
            other = self.both()
            out = (out | other) if op == "or" else (out != other)
        return out

    def both(self) -> Column:
        out = self.single()
        while self.operator(2):
            self.take()
            out = out & self.single()
        return out

    def single(self) -> Column:
        if self.operator(3):
            self.take()
            return ~self.single()
        word, protected = self.peek()
        if (word, protected) == ("(", False):
            self.take()
            out = self.either()
            self.take(")")
            return out
        self.take()
        if protected:
            return self.member(word)
        if word.lower() in OPERATORS:
            raise SelectionError(f"no operand before {word!r}")
        if self.peek() == ("[", False) and word in FUNCTIONS:
            return self.function(word)
        if self.peek()[0] in ("<", ">", "<=", ">=") and not self.peek()[1]:
            return self.comparison(word)
        return self.member(word)

    def member(self, word: str) -> Column:
        if not word or word in ("[", "]", ")", "<", ">", "<=", ">="):
            raise SelectionError(f"no operand: {word!r}")
        if re.fullmatch(r"[+-]?\d+", word):
            self.made.attributes.add(int(word))
            return F.array_contains(F.col("attributes"), int(word))
        self.made.names.add(word)
        return F.array_contains(F.col("groups"), word)

    def comparison(self, first: str) -> Column:
        sign, second = self.take(), self.take()
        turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
        if first.lower() not in ("x", "y", "z"):
            first, second, sign = second, first, turned[sign]
        if first.lower() not in ("x", "y", "z"):
            raise SelectionError("comparisons are of x, y or z")
        axis, value = F.col(first.lower()), F.lit(float(second))
        self.made.needs_coordinates = True
        return {"<": axis < value, ">": axis > value, "<=": axis <= value, ">=": axis >= value}[sign]

    def arguments(self) -> tuple[list[str], dict[str, str]]:
        self.take("[")
        plain, named = [], {}
        while self.peek() != ("]", False):
            word = self.take()
            if word == ",":
                continue
            key, equals, value = word.partition("=")
            if equals or self.peek()[0] == "=":
                if not equals:
                    self.take()
                named[key.strip()] = (value or self.take()).strip()
            else:
                plain.append(word)
        self.take("]")
        return plain, named

    def function(self, name: str) -> Column:
        plain, named = self.arguments()
        try:
            return self.called(name, plain, named)
        except (IndexError, ValueError, TypeError, ZeroDivisionError) as wrong:
            raise SelectionError(f"wrong arguments of {name}[{', '.join(plain)}]") from wrong

    def called(self, name: str, plain: list[str], named: dict[str, str]) -> Column:
        if name == "all":
            return F.lit(True)
        if name == "no_group":
            return (F.size("groups") == 0) & (F.size("attributes") == 0)
        if name == "range":
            words = list(plain)
            kind = words.pop() if words[-1] in ("group", "attribute") else None
            low, high = words
            if kind != "group" and all(re.fullmatch(r"[+-]?\d+", v) for v in words):
                return F.exists("attributes", lambda a: a.between(int(low), int(high)))
            return F.exists("groups", lambda g: g.between(low, high))
        words = [w for w in plain if w in ("inside", "outside")]
        numbers = [float(w) for w in plain if w not in words]
        if name == "normal":
            self.made.needs_normals = True
            eps = numbers[3] if len(numbers) > 3 else float(named.get("epsilon", 1e-2))
            length = math.sqrt(sum(v * v for v in numbers[:3]))
            n = [F.col(c) for c in ("nx", "ny", "nz")]
            along = sum((c * (v / length) for c, v in zip(n, numbers[:3], strict=True)), F.lit(0.0))
            return (along > 0) & (along * along > (1 - eps) ** 2 * sum((c * c for c in n), F.lit(0.0)))
        self.made.needs_coordinates = True
        x = [F.col(c) for c in ("x", "y", "z")]
        if name == "sphere":
            return sum(((c - v) * (c - v) for c, v in zip(x, numbers[:3], strict=True)), F.lit(0.0)) <= numbers[3] ** 2
        if name == "plane":
            count = 6 if len(numbers) >= 6 else 4
            length = math.sqrt(sum(v * v for v in numbers[:3]))
            n = [v / length for v in numbers[:3]]
            shift = -sum(a * b for a, b in zip(n, numbers[3:6], strict=True)) if count == 6 else numbers[3] / length
            value = sum((c * v for c, v in zip(x, n, strict=True)), F.lit(shift))
            if words:
                return value <= 0 if words[0] == "inside" else value >= 0
            eps = numbers[count] if len(numbers) > count else float(named.get("epsilon", 1e-2))
            return F.abs(value) < eps
        if name == "box" and len(numbers) == 6:
            return x[0].between(numbers[0], numbers[3]) & x[1].between(numbers[1], numbers[4]) & x[2].between(numbers[2], numbers[5])
        if name == "box":
            away = [c - v for c, v in zip(x, numbers[:3], strict=True)]
            out = F.lit(True)
            for k in (3, 6, 9):
                side = numbers[k : k + 3]
                at = sum((c * v for c, v in zip(away, side, strict=True)), F.lit(0.0))
                out = out & at.between(0.0, sum(v * v for v in side))
            return out
        along = [b - a for a, b in zip(numbers[:3], numbers[3:6], strict=True)]
        length2 = sum(v * v for v in along)
        away = [c - v for c, v in zip(x, numbers[:3], strict=True)]
        at = sum((c * v for c, v in zip(away, along, strict=True)), F.lit(0.0))
        # across the axis by the cross product: a difference of squares would round points on the surface away
        across = [away[i] * along[j] - away[j] * along[i] for i, j in ((1, 2), (2, 0), (0, 1))]
        return at.between(0.0, length2) & (sum((c * c for c in across), F.lit(0.0)) <= numbers[6] ** 2 * length2)


def parsed(text: str) -> Selection:
    return Parser(text).whole()


def select(elements: DataFrame, text: str) -> DataFrame:
    """The rows of `elements` that `text` selects; columns groups, attributes, x, y, z, nx, ny, nz as it needs."""
    wanted = parsed(text)
    missing = [c for c, need in (("x", wanted.needs_coordinates), ("nx", wanted.needs_normals), ("groups", bool(wanted.names)), ("attributes", bool(wanted.attributes))) if need and c not in elements.columns]
    if missing:
        raise SelectionError(f"the data have no {missing}")
    return elements.where(wanted.condition)


def missing_operands(elements: DataFrame, text: str) -> list[str]:
    """Group names and attributes of `text` that no element has."""
    wanted = parsed(text)
    groups = {r[0] for r in elements.select(F.explode("groups")).distinct().where(F.col("col").isin(list(wanted.names) or [""])).collect()}
    numbers = {r[0] for r in elements.select(F.explode("attributes")).distinct().where(F.col("col").isin(list(wanted.attributes) or [0])).collect()}
    return sorted(wanted.names - groups) + [str(a) for a in sorted(wanted.attributes - numbers)]
