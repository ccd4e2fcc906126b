"""Task templates as Columns: text with {{ expressions }} and {% if %} blocks, compiled against a schema.

The forms that task files use: fields, attributes and indices, string methods and filters,
lists, literals, concatenation, comparisons, conditions. What isn't known is an error when a
template is compiled, never a wrong prompt.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import gold_index, strip


@dataclass(frozen=True)
class Value:
    """A compiled expression: its column and the type that decides how it prints and whether it is true."""

    column: Column
    kind: T.DataType

    def text(self) -> Column:
        if isinstance(self.kind, T.BooleanType):
            shown = F.when(self.column, "True").otherwise("False")
            return F.when(self.column.isNotNull(), shown).otherwise("None")
        if isinstance(self.kind, (T.ArrayType, T.StructType, T.MapType)):
            raise ValueError("a list or a record isn't printed; take one of its parts")
        return F.coalesce(self.column.cast("string"), F.lit("None"))

    def truth(self) -> Column:
        if isinstance(self.kind, T.BooleanType):
            out = self.column
        elif isinstance(self.kind, T.StringType):
            out = self.column != ""
        elif isinstance(self.kind, (T.ArrayType, T.MapType)):
            out = F.size(self.column) > 0
        elif isinstance(self.kind, T.NumericType):
            out = self.column != 0
        else:
            out = self.column.isNotNull()
        return F.coalesce(out, F.lit(False))


def _string(column: Column) -> Value:
    return Value(column, T.StringType())


def _length(v: Value) -> Value:
    return Value(F.size(v.column) if isinstance(v.kind, (T.ArrayType, T.MapType)) else F.char_length(v.text()), T.IntegerType())


def _joined(v: Value, by: Value | None = None) -> Value:
    if not isinstance(v.kind, T.ArrayType):
        raise ValueError("join takes a list")
    return _string(F.array_join(v.column.cast("array<string>"), "", "None") if by is None else F.aggregate(F.transform(v.column.cast("array<string>"), lambda x: F.coalesce(x, F.lit("None"))), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, by.text(), x)), lambda a: F.coalesce(a, F.lit(""))))


#: What filters and methods do; both are called with the value before them.
FUNCTIONS: dict[str, Callable[..., Value]] = {
    "strip": lambda v: _string(strip(v.text())),
    "trim": lambda v: _string(strip(v.text())),
    "lstrip": lambda v: _string(F.regexp_replace(v.text(), r"(?U)^\s+", "")),
    "rstrip": lambda v: _string(F.regexp_replace(v.text(), r"(?U)\s+$", "")),
    "lower": lambda v: _string(F.lower(v.text())),
    "upper": lambda v: _string(F.upper(v.text())),
    "capitalize": lambda v: _string(F.concat(F.upper(F.substring(v.text(), 1, 1)), F.lower(F.substring(v.text(), 2, 1 << 30)))),
    "replace": lambda v, old, new: _string(F.replace(v.text(), old.text(), new.text())),
    "split": lambda v, by: Value(F.split(v.text(), F.concat(F.lit("\\Q"), by.text(), F.lit("\\E"))), T.ArrayType(T.StringType())),
    "length": _length,
    "count": _length,
    "join": _joined,
    "default": lambda v, other: _string(F.coalesce(v.column.cast("string"), other.text())),
    "string": lambda v: _string(v.text()),
    "int": lambda v: Value(v.column.try_cast("int"), T.IntegerType()),
    "first": lambda v: Value(F.get(v.column, F.lit(0)), v.kind.elementType),
    "last": lambda v: Value(F.element_at(v.column, -1), v.kind.elementType),
}
METHODS = {"strip", "lstrip", "rstrip", "lower", "upper", "capitalize", "replace", "split"}
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>\[\](),.|]))")


class Expression:
    """Compiles one expression by precedence: condition, or, and, not, comparison, sum, part."""

    def __init__(self, source: str, fields: dict[str, T.DataType]):
        self.source, self.fields, self.at = source, fields, 0
        self.tokens, end = [], 0
        while source[end:].strip():
            m = _TOKEN.match(source, end)
            if not m:
                raise ValueError(f"not understood in a template: {source[end:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            end = m.end()

    def compiled(self) -> Value:
        out = self._condition()
        if self.at < len(self.tokens):
            raise ValueError(f"not understood in a template: {self.tokens[self.at][1]!r} in {self.source!r}")
        return out

    def _next(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != 2 and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _must(self, text: str) -> None:
        if not self._next(text):
            raise ValueError(f"{text!r} is missing in {self.source!r}")

    def _condition(self) -> Value:
        out = self._either()
        if self._next("if"):
            test = self._either().truth()
            other = self._condition() if self._next("else") else _string(F.lit(""))
            same = out.kind == other.kind
            out = Value(F.when(test, out.column if same else out.text()).otherwise(other.column if same else other.text()), out.kind if same else T.StringType())
        return out

    def _either(self) -> Value:
        out = self._both()
        while self._next("or"):
            out = Value(out.truth() | self._both().truth(), T.BooleanType())
        return out

    def _both(self) -> Value:
        out = self._negated()
        while self._next("and"):
            out = Value(out.truth() & self._negated().truth(), T.BooleanType())
        return out

    def _negated(self) -> Value:
        if self._next("not"):
            return Value(~self._negated().truth(), T.BooleanType())
        out = self._sum()
        while op := self._next("==", "!=", "<", ">", "<=", ">=", "in"):
            other = self._sum()
            if op == "in":
                found = F.array_contains(other.column, out.column) if isinstance(other.kind, T.ArrayType) else F.contains(other.text(), out.text())
            else:
                numbers = isinstance(out.kind, T.NumericType) and isinstance(other.kind, T.NumericType)
                a, b = (out.column, other.column) if numbers else (out.text(), other.text())
                found = {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
                if isinstance(out.kind, T.NumericType) != isinstance(other.kind, T.NumericType):
                    if op not in ("==", "!="):
                        raise ValueError(f"a number and a text aren't ordered: {self.source!r}")
                    found = F.lit(op == "!=")  # a number never equals a text
            out = Value(F.coalesce(found, F.lit(False)), T.BooleanType())
        return out

    def _sum(self) -> Value:
        out = self._part()
        while op := self._next("+", "~", "-"):
            other = self._part()
            if op != "~" and isinstance(out.kind, T.NumericType) and isinstance(other.kind, T.NumericType):
                out = Value(out.column + other.column if op == "+" else out.column - other.column, out.kind)
            elif op == "+" and isinstance(out.kind, T.ArrayType) and isinstance(other.kind, T.ArrayType):
                out = Value(F.concat(out.column, other.column), out.kind)
            elif op == "-":
                raise ValueError(f"only numbers are subtracted: {self.source!r}")
            else:
                out = _string(F.concat(out.text(), other.text()))
        return out

    def _arguments(self) -> list[Value]:
        out: list[Value] = []
        while not self._next(")"):
            if out:
                self._must(",")
            out.append(self._condition())
        return out

    def _call(self, name: str, v: Value, known: set[str] | dict) -> Value:
        if name not in known:
            raise ValueError(f"no {name!r} in templates: {self.source!r}")
        return FUNCTIONS[name](v, *(self._arguments() if self._next("(") else []))

    def _part(self) -> Value:
        out = self._primary()
        while op := self._next(".", "[", "|"):
            if op == "[":
                at = self._condition()
                self._must("]")
                if isinstance(at.kind, T.StringType):
                    out = self._field(out, at.column)
                else:
                    place = F.when(at.column < 0, F.size(out.column) + at.column).otherwise(at.column) if isinstance(out.kind, T.ArrayType) else None
                    if place is None:
                        raise ValueError(f"only a list has places: {self.source!r}")
                    out = Value(F.get(out.column, place.cast("int")), out.kind.elementType)
            else:
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
                if kind != 3:
                    raise ValueError(f"a name is missing in {self.source!r}")
                self.at += 1
                if op == ".":
                    out = self._call(name, out, METHODS) if self.at < len(self.tokens) and self.tokens[self.at][1] == "(" else self._field(out, name)
                else:
                    out = self._call(name, out, FUNCTIONS)
        return out

    def _field(self, out: Value, name) -> Value:
        if isinstance(out.kind, T.MapType):
            return Value(F.try_element_at(out.column, F.lit(name)), out.kind.valueType)
        if isinstance(out.kind, T.StructType) and isinstance(name, str) and name in out.kind.names:
            return Value(out.column[name], out.kind[name].dataType)
        if isinstance(out.kind, T.StructType) and not isinstance(name, str):
            raise ValueError(f"a record's field is written .name: {self.source!r}")
        raise ValueError(f"no field {name!r} in {self.source!r}")

    def _primary(self) -> Value:
        if self.at >= len(self.tokens):
            raise ValueError(f"{self.source!r} ends too soon")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Value(F.lit(float(text)), T.DoubleType()) if "." in text else Value(F.lit(int(text)), T.IntegerType())
        if kind == 2:
            return _string(F.lit(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])))
        if kind == 3:
            if text in ("true", "True", "false", "False"):
                return Value(F.lit(text.lower() == "true"), T.BooleanType())
            if text not in self.fields:
                raise ValueError(f"no field {text!r} for the template {self.source!r}")
            return Value(F.col(f"`{text}`"), self.fields[text])
        if text == "-":
            v = self._part()
            return Value(-v.column, v.kind)
        if text == "(":
            v = self._condition()
            self._must(")")
            return v
        if text == "[":
            items: list[Value] = []
            while not self._next("]"):
                if items:
                    self._must(",")
                items.append(self._condition())
            return Value(F.array(*[v.text() for v in items]) if items else F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        raise ValueError(f"not understood in a template: {text!r} in {self.source!r}")


_BLOCK = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)


class Template:
    """A template's text: pieces to be joined, with conditions as a stack of branches."""

    def __init__(self, source: str, schema: T.StructType):
        self.fields = {f.name: f.dataType for f in schema.fields}
        # a block with a dash takes the white space beside it along, and one line end follows {% %} in vain
        source = re.sub(r"\s*(\{[{%#])-", r"\1", source)
        source = re.sub(r"-([}%#]\})\s*", r"\1", source)
        self.pieces = [p for p in _BLOCK.split(source) if p]
        self.at = 0

    def value(self) -> Value:
        """The value of a template that is one expression, the text of any other."""
        if len(self.pieces) == 1 and self.pieces[0].startswith("{{"):
            return Expression(self.pieces[0][2:-2], self.fields).compiled()
        out = self._until()
        if self.at < len(self.pieces):
            raise ValueError(f"{self.pieces[self.at]} without an if")
        return _string(out)

    def _until(self) -> Column:
        out: list[Column] = []
        while self.at < len(self.pieces):
            piece = self.pieces[self.at]
            if piece.startswith("{%"):
                words = piece[2:-2].strip().split(None, 1)
                if words[0] in ("elif", "else", "endif"):
                    break
                if words[0] != "if":
                    raise ValueError(f"no {words[0]!r} in templates")
                self.at += 1
                out.append(self._branches(words[1]))
                continue
            self.at += 1
            if piece.startswith("{{"):
                out.append(Expression(piece[2:-2], self.fields).compiled().text())
            elif not piece.startswith("{#"):
                out.append(F.lit(piece))
        return F.concat(*out) if out else F.lit("")

    def _branches(self, test: str) -> Column:
        """From behind an if to behind its endif."""
        condition = Expression(test, self.fields).compiled().truth()
        own = self._until()
        if self.at >= len(self.pieces):
            raise ValueError("an if without an endif")
        words = self.pieces[self.at][2:-2].strip().split(None, 1)
        self.at += 1
        if words[0] == "endif":
            return F.when(condition, own).otherwise(F.lit(""))
        if words[0] == "elif":
            return F.when(condition, own).otherwise(self._branches(words[1]))
        other = self._until()
        if self.at >= len(self.pieces) or self.pieces[self.at][2:-2].strip() != "endif":
            raise ValueError("an else without an endif")
        self.at += 1
        return F.when(condition, own).otherwise(other)


def rendered(source: str, schema: T.StructType) -> Column:
    """The text that a template gives each row. Nulls print as None, as the templates' own language prints them."""
    return Template(source, schema).value().text()


def prompts(docs: DataFrame, spec: dict) -> DataFrame:
    """docs with prompt, choices (array<string>) and gold (index; -100 if the target is none of them).

    spec: a task's doc_to_text, doc_to_choice and doc_to_target, each the name of a column, a
    template or a literal (for choices a list, or its JSON; for the target an index).
    """
    names, schema = set(docs.columns), docs.schema
    source = str(spec.get("doc_to_text") or "")
    prompt = F.coalesce(F.col(source).cast("string"), F.lit("")) if source in names else rendered(source, schema)
    choice = spec["doc_to_choice"]
    if isinstance(choice, str) and choice.lstrip().startswith("["):
        choice = json.loads(choice)
    if isinstance(choice, list):
        choices = F.array(*[F.lit(str(c)) for c in choice])
    elif choice in names:
        choices = F.col(choice).cast("array<string>")
    else:
        value = Template(choice, schema).value()
        if not isinstance(value.kind, T.ArrayType):
            raise ValueError(f"choices are a list: {choice!r}")
        choices = value.column
    target = spec.get("doc_to_target")
    if isinstance(target, int) or re.fullmatch(r"\d+", str(target)):
        gold = F.lit(int(target))
    else:
        gold = F.col(target) if target in names else rendered(str(target), schema)
    return docs.select("*", prompt.alias("prompt" if "prompt" not in names else "__prompt"), choices.alias("__choices")).transform(lambda df: _named(df, gold, names))


def _named(df: DataFrame, gold: Column, names: set[str]) -> DataFrame:
    df = df.withColumn("__gold", gold_index(gold, F.col("__choices")))
    new = [("__prompt", "prompt")] if "__prompt" in df.columns else []
    for old, name in [*new, ("__choices", "choices"), ("__gold", "gold")]:
        df = df.drop(name).withColumnRenamed(old, name)
    return df
