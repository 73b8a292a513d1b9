"""Symbols, calls and imports of a Python file, by the standard parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

from .symbols import Symbol, hashed

#: Decorators that make a function an entry point.
ENTRY_POINTS = (
    "app.route", "app.get", "app.post", "app.put", "app.delete", "app.patch", "router.get", "router.post", "router.put", "router.delete",
    "api_view", "action", "task", "celery_task", "click.command", "click.group", "pytest.fixture",
)

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert)


#: Fields that hold no nodes, or only such as say how a name is used or which operator it is.
_PLAIN = ("ctx", "id", "attr", "arg", "op", "ops", "module", "level", "kind", "type_comment", "asname")


class Parameter(NamedTuple):
    name: str
    annotation: str | None
    has_default: bool

    def shown(self) -> str:
        return self.name + (f": {self.annotation}" if self.annotation else "") + " = ..." * self.has_default


@cache
def _inner(kind: type) -> tuple[str, ...]:
    return () if kind is ast.Constant else tuple(f for f in kind._fields if f not in _PLAIN)


class _Def:
    """What is in a function: its complexity (1, and one for each branch, loop, handler and assertion, and for each further operand of and / or), and the names it calls."""

    __slots__ = ("node", "outer", "complexity", "calls")

    def __init__(self, node: ast.AST | None, outer: _Def | None):
        self.node, self.outer, self.complexity, self.calls = node, outer, 1, set()


def _walk(tree: ast.Module) -> tuple[list[_Def], list[str]]:
    """(all functions, breadth first, with what is in those inside them, the modules that are imported), in one pass over the tree."""
    top, defs, modules = _Def(None, None), [], []
    level: list[tuple[ast.AST, _Def]] = [(tree, top)]
    for node, own in level:  # grows as it goes
        kind = type(node)
        if kind in _DEFS:
            own = _Def(node, own)
            defs.append(own)
        elif kind is ast.Call:
            own.calls.add(_name(node.func))
        elif kind in _BRANCHES:
            own.complexity += 1
        elif kind is ast.BoolOp:
            own.complexity += len(node.values) - 1
        elif kind is ast.Import:
            modules += [a.name for a in node.names]
        elif kind is ast.ImportFrom and node.module:
            modules.append(node.module)
        for field in _inner(kind):
            value = getattr(node, field, None)
            if type(value) is list:
                level += [(x, own) for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.AST):
                level.append((value, own))
    for d in reversed(defs):  # inner ones come after those around them
        d.outer.complexity += d.complexity - 1
        d.outer.calls |= d.calls
    return defs, modules


def parameters(args: ast.arguments) -> list[Parameter]:
    """Those that may be given by place, without self and cls, then the starred ones."""
    last_first = zip(reversed(args.args), [True] * len(args.defaults) + [False] * len(args.args), strict=False)
    plain = [Parameter(a.arg, ast.unparse(a.annotation) if a.annotation else None, given) for a, given in last_first if a.arg not in ("self", "cls")]
    starred = [Parameter(stars + a.arg, None, False) for stars, a in (("*", args.vararg), ("**", args.kwarg)) if a]
    return plain[::-1] + starred


def _symbol(path: str, node, kind: str, owner: str | None, lines: list[str], counted: dict[ast.AST, int]) -> Symbol:
    name, is_def = node.name, isinstance(node, _DEFS)
    own = "\n".join(lines[node.lineno - 1 : node.end_lineno])
    if is_def:
        given = parameters(node.args)
        names = [p.name for p in given]
        head = f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {name}({', '.join(p.shown() for p in given)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
    else:
        names = [m.name for m in node.body if isinstance(m, _DEFS)]
        head = f"class {name}" + (f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else "")
    entry = is_def and (name == "main" or any(ast.unparse(d).lower() in ENTRY_POINTS for d in node.decorator_list))
    return Symbol(path, name, f"{owner}.{name}" if owner else name, kind, owner, head, ast.get_docstring(node), node.lineno, node.end_lineno, counted.get(node), not name.startswith("_"), entry, names, own, hashed(own), None)


def _symbols(path: str, text: str, tree: ast.Module, defs: list[_Def]) -> Iterator[Symbol]:
    """Functions, classes and methods at the top."""
    lines, counted = text.split("\n"), {d.node: d.complexity for d in defs}
    for node in tree.body:
        if isinstance(node, _DEFS):
            yield _symbol(path, node, "function", None, lines, counted)
        elif isinstance(node, ast.ClassDef):
            yield _symbol(path, node, "class", None, lines, counted)
            yield from (_symbol(path, m, "method", node.name, lines, counted) for m in node.body if isinstance(m, _DEFS))


def _name(f: ast.AST) -> str | None:
    """The dotted name that is called; of what begins with ``self`` the name after it; of what begins with no name its attributes."""
    parts = []
    while isinstance(f, ast.Attribute):
        parts.insert(0, f.attr)
        f = f.value
    if isinstance(f, ast.Name):
        if f.id == "self" and parts:
            return parts[0]
        parts.insert(0, f.id)
    return ".".join(parts) or None


def _calls(path: str, defs: list[_Def]) -> Iterator[tuple]:
    """(file, function, called name), also of nested functions; a function's calls of its own name are left out."""
    for d in defs:
        yield from ((path, d.node.name, n) for n in sorted(x for x in d.calls if x and x != d.node.name))


def read_python(path: str, text: str) -> tuple[list[Symbol], list[tuple], list[tuple]]:
    """Raises SyntaxError, ValueError or RecursionError where the parser can't read the file."""
    tree = ast.parse(text)
    defs, modules = _walk(tree)
    return list(_symbols(path, text, tree, defs)), list(_calls(path, defs)), [(path, m) for m in modules]
