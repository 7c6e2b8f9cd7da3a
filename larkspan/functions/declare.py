"""Declarations of C-style functions with the kinds of their arguments, as text.

    @split (n: Rows(), a: Rows(n), b: broadcast) -> Rows() default b: 1.0 {
        void scale(long n, const double *a, double b);
    }

Each function in braces takes the kinds by position; a result kind is needed
exactly if a function returns something. Types are words, optionally const,
struct or union, with any number of stars. register() makes registered
functions of declarations; the command line writes a module that does.
"""

from __future__ import annotations

import argparse
import inspect
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass

from . import registry as X

TOKEN = re.compile(r"\s*(->|[A-Za-z_]\w*|\d+(?:\.\d+)?|\S)")


@dataclass(frozen=True)
class Kind:
    """broadcast, a generic capital letter, or a named type with argument names."""

    name: str
    args: tuple[str, ...] = ()
    form: str = "named"


@dataclass(frozen=True)
class Declaration:
    result: str
    name: str
    params: tuple[tuple[str, str | None], ...]


@dataclass(frozen=True)
class Annotation:
    params: tuple[tuple[str, Kind], ...]
    result: Kind | None
    defaults: tuple[tuple[str, str], ...]
    functions: tuple[Declaration, ...]

    def positions(self) -> dict[str, int]:
        return {name: i for i, (name, _) in enumerate(self.params)}


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
        while text[at:].strip():
            m = TOKEN.match(text, at)
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if t is None or wanted is not None and t != wanted:
            raise ValueError(f"expected {wanted or 'more'}, found {t}")
        self.at += 1
        return t

    def word(self) -> str:
        t = self.take()
        if not re.fullmatch(r"[A-Za-z_]\w*", t):
            raise ValueError(f"expected a name, found {t}")
        return t

    def list_of(self, item, close: str = ")") -> list:
        out = []
        while self.peek() != close:
            out.append(item())
            if self.peek() != close:
                self.take(",")
        self.take(close)
        return out

    def kind(self) -> Kind:
        name = self.word()
        if self.peek() == "(":
            self.take("(")
            return Kind(name, tuple(self.list_of(self.word)))
        if name == "broadcast":
            return Kind(name, form="broadcast")
        if re.fullmatch(r"[A-Z]", name):
            return Kind(name, form="generic")
        raise ValueError(f"{name} needs its arguments in parentheses")

    def param(self) -> tuple[str, Kind]:
        name = self.word()
        self.take(":")
        return name, self.kind()

    def c_type(self) -> str:
        parts = []
        if self.peek() == "const":
            parts.append(self.take())
        if self.peek() in ("struct", "union"):
            parts.append(self.take())
        parts.append(self.word())
        stars = ""
        while self.peek() == "*":
            stars += self.take()
        return " ".join(parts) + (" " + stars if stars else "")

    def c_param(self) -> tuple[str, str | None]:
        kind = self.c_type()
        return kind, self.word() if self.peek() not in (",", ")") else None

    def declaration(self) -> Declaration:
        result, name = self.c_type(), self.word()
        self.take("(")
        out = Declaration(result, name, tuple(self.list_of(self.c_param)))
        self.take(";")
        return out

    def done(self):
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()}")


def parse_kind(text: str) -> Kind:
    r = _Reader(text)
    out = r.kind()
    r.done()
    return out


def parse_param(text: str) -> tuple[str, Kind]:
    r = _Reader(text)
    out = r.param()
    r.done()
    return out


def parse_type(text: str) -> str:
    r = _Reader(text)
    out = r.c_type()
    r.done()
    return out


def parse_declaration(text: str) -> Declaration:
    r = _Reader(text)
    out = r.declaration()
    r.done()
    return out


def parse(text: str) -> list[Annotation]:
    """All annotations of a text, checked."""
    r, out = _Reader(text), []
    while r.peek() is not None:
        r.take("@")
        r.word()
        r.take("(")
        params = r.list_of(r.param)
        result, defaults, functions = None, [], []
        if r.peek() == "->":
            r.take()
            result = r.kind()
        while r.peek() == "default":
            r.take()
            name = r.word()
            r.take(":")
            defaults.append((name, r.take()))
        r.take("{")
        while r.peek() != "}":
            functions.append(r.declaration())
        r.take("}")
        names = [n for n, _ in params]
        if len(set(names)) != len(names):
            raise ValueError("a parameter is named twice")
        for used in [*(a for _, k in params for a in k.args), *(result.args if result else ()), *(d for d, _ in defaults)]:
            if used not in names:
                raise ValueError(f"unknown parameter {used}")
        for f in functions:
            if (f.result == "void") != (result is None):
                raise ValueError(f"{f.name}: a result kind is needed exactly for functions that return something")
            if len(f.params) != len(params):
                raise ValueError(f"{f.name} has {len(f.params)} parameters, the annotation {len(params)}")
        out.append(Annotation(tuple(params), result, tuple(defaults), tuple(functions)))
    return out


#: The registry's kind of a declared one; a generic letter is whatever its other uses and the call's other arguments make it: rows.
MEANING = {"Rows": X.ROWS, "Size": X.WHOLE, "Total": X.TOTAL, "Distinct": X.DISTINCT, "Groups": X.GROUPS, "Batches": X.BATCHES}
#: Column types of C types; pointers are columns of what they point to.
COLUMN_TYPES = {"double": "double", "float": "float", "long": "bigint", "int": "int", "short": "smallint", "char": "string", "bool": "boolean"}


def column_type(c_type: str) -> str:
    """The column type of a C type: const and stars say nothing about it."""
    base = c_type.replace("const ", "").rstrip("* ").split()[-1]
    if base not in COLUMN_TYPES:
        raise ValueError(f"no column type for {c_type}")
    return COLUMN_TYPES[base]


def meanings(a: Annotation, bound: dict[str, str] | None = None) -> tuple[tuple[str, ...], str | None]:
    """The registry's kinds of the parameters and of the result. bound gives kinds of generic letters; one letter has one kind throughout."""
    bound = dict(bound or {})

    def of(kind: Kind) -> str:
        if kind.form == "broadcast":
            return X.WHOLE
        if kind.form == "generic":
            return bound.setdefault(kind.name, X.ROWS)
        if kind.name not in MEANING:
            raise ValueError(f"unknown kind {kind.name}")
        return MEANING[kind.name]

    return tuple(of(k) for _, k in a.params), of(a.result) if a.result else None


def register(text: str, functions: dict[str, Callable], native: dict[str, Callable] | None = None, bound: dict[str, str] | None = None) -> dict[str, X.Registered]:
    """Registers the declared functions, which are given by name, with the kinds, defaults and result types of their declarations."""
    out = {}
    for a in parse(text):
        kinds, result = meanings(a, bound)
        for d in a.functions:
            if result is None:
                raise ValueError(f"{d.name} returns nothing; columns cannot be changed in place")
            if d.name not in functions:
                raise ValueError(f"{d.name} is declared but not given")
            defaults = {name: float(value) if re.fullmatch(r"[\d.]+", value) else value for name, value in a.defaults}
            schema = column_type(d.result) if result == X.ROWS else f"value {column_type(d.result)}"
            out[d.name] = X.splittable(kinds, result, schema, (native or {}).get(d.name), name=d.name)(_with_defaults(functions[d.name], [n for n, _ in a.params], defaults))
    return out


def _with_defaults(f: Callable, names: list[str], defaults: dict) -> Callable:
    """f with the declared parameter names and their defaults."""
    kind, none = inspect.Parameter.POSITIONAL_OR_KEYWORD, inspect.Parameter.empty
    signature = inspect.Signature([inspect.Parameter(n, kind, default=defaults.get(n, none)) for n in names])

    def wrapped(*args, **named):
        given = signature.bind(*args, **named)
        given.apply_defaults()
        return f(*given.args)

    wrapped.__signature__, wrapped.__name__ = signature, f.__name__
    return wrapped


def module_of(text: str, source: str, prefix: str = "") -> str:
    """Python source of a module that registers the declared functions of the module `source`, each under its prefixed name."""
    names = [d.name for a in parse(text) for d in a.functions]
    lines = ['"""Generated from declarations; registers the functions of ' + source + '."""', "", f"import {source} as _source", "from larkspan.functions import declare", "", f"DECLARATIONS = {text!r}", "_found = declare.register(DECLARATIONS, {name: getattr(_source, name) for name in " + repr(names) + "})"]
    return "\n".join([*lines, *(f"{prefix}{n} = _found[{n!r}]" for n in names), ""])


def main(args: list[str] | None = None) -> int:
    """python -m larkspan.functions.declare FILE -m MODULE [-o OUT] [-p PREFIX] [-d]"""
    p = argparse.ArgumentParser(prog="larkspan.functions.declare", description="Checks a file of declarations and writes a module that registers the functions.")
    p.add_argument("file")
    p.add_argument("-m", "--module", help="the module that has the functions; without it the file is only checked")
    p.add_argument("-o", "--out", help="where the module goes; standard output by default")
    p.add_argument("-p", "--prefix", default="", help="before the names of the registered functions")
    p.add_argument("-d", "--debug", action="store_true", help="show what was read")
    given = p.parse_args(args)
    with open(given.file, encoding="utf-8") as f:
        text = f.read()
    try:
        found = parse(text)
    except ValueError as e:
        print(f"{given.file}: {e}", file=sys.stderr)
        return 1
    if given.debug:
        print(*found, sep="\n", file=sys.stderr)
    if given.module:
        source = module_of(text, given.module, given.prefix)
        if given.out:
            with open(given.out, "w", encoding="utf-8") as f:
                f.write(source)
        else:
            print(source, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
