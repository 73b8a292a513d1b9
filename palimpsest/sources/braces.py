"""Symbols, calls and imports of JavaScript, TypeScript and Go files, from tokens and the brackets that enclose them.

Functions, arrow functions and function expressions given a name, classes with their methods and field functions; of Go functions,
methods by their receiver, and structs and interfaces. Functions within functions are symbols of their own, those within a
method aren't. A call goes to the innermost symbol around it. JSX is read as script.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from .symbols import Symbol, hashed
from .lexer import brackets, tokens

#: Names that make a script's function an entry point, in lower case.
ENTRY_POINTS = ("main", "handler", "default", "createhandler", "getserversideprops", "getstaticprops", "getstaticpaths", "test", "it", "describe", "beforeeach", "aftereach")

_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "import", "with", "do", "else", "case", "yield", "throw", "void", "delete", "in", "of", "instanceof", "async"}
_GO_WORDS = {"if", "for", "switch", "select", "func", "return", "go", "defer", "range", "case", "var", "const", "type", "struct", "interface", "map", "chan", "import", "package", "else"}
_MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "override", "get", "set", "declare", "accessor", "abstract"}
_CONTINUES = {"+", "-", "*", "/", "%", "?", ":", ".", "?.", "&&", "||", "??", "=", "=>", "<", ">", "==", "===", "!=", "!==", ","}


class _File:
    """What both languages' readers share: tokens, brackets, lines."""

    def __init__(self, path: str, text: str, raw_strings: bool):
        self.path, self.text = path, text
        self.tokens, self.comments = tokens(text, raw_strings)
        self.match = brackets(self.tokens)
        self.opens = {close: i for i, close in enumerate(self.match) if close > i}
        self.angled: dict[int, int] = {}
        self.lines = text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.symbols: list[Symbol] = []
        self.spans: list[tuple[int, int, str]] = []  # first and last token, and name, of functions and methods

    def is_mark(self, i: int, text: str) -> bool:
        return i < len(self.tokens) and self.tokens[i].kind == "mark" and self.tokens[i].text == text

    def word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind == "name" else ""

    def source(self, first: int, last: int) -> str:
        """The text from one token to another, on one line."""
        return " ".join(self.text[self.tokens[first].begin : self.tokens[last].end].split()) if first <= last else ""

    def line(self, i: int, end: bool = False) -> int:
        t = self.tokens[i]
        return bisect.bisect_right(self.starts, t.end - 1 if end else t.begin)

    def angles(self, i: int) -> int:
        """What follows the type parameters that begin here, if any do."""
        if not self.is_mark(i, "<"):
            return i
        if i not in self.angled:
            self.angled[i] = self.angle_end(i)
        return self.angled[i]

    def angle_end(self, i: int) -> int:
        depth = 0
        for k in range(i, min(len(self.tokens), i + 400)):
            t = self.tokens[k]
            if t.kind == "mark":
                if t.text == "<":
                    depth += 1
                elif t.text and set(t.text) == {">"}:
                    depth -= len(t.text)
                    if depth <= 0:
                        return k + 1
                elif t.text == ";":
                    break
        return i

    def split(self, first: int, last: int) -> list[tuple[int, int]]:
        """(first, last) token of each part between the commas of a bracket."""
        parts, begin, i = [], first + 1, first + 1
        while i < last:
            if self.is_mark(i, ","):
                parts.append((begin, i - 1))
                begin = i + 1
            i = (self.match[i] if self.match[i] > i else self.angles(i) - 1 if self.angles(i) > i else i) + 1
        parts.append((begin, last - 1))
        return [(a, b) for a, b in parts if a <= b]

    def complexity(self, first: int, last: int) -> int:
        """1, and one for each branch, loop, case, handler, conditional expression, && and ||."""
        n = 1
        for i in range(first, last + 1):
            t = self.tokens[i]
            if t.kind == "name":
                n += t.text in ("if", "for", "while", "case", "catch") and not self.is_mark(i - 1, ".")
            elif t.kind == "mark":
                n += t.text in ("&&", "||") or t.text == "?" and not (i < last and self.tokens[i + 1].text in (":", ")", ",", "=", ";"))
        return n

    def add(self, name: str, kind: str, owner: str | None, signature: str, doc: str, first: int, last: int, public: bool, entry: bool, parameters: list[str], measured: bool = True) -> None:
        a, b = self.line(first), self.line(last, end=True)
        code = "\n".join(self.lines[a - 1 : b])
        self.symbols.append(Symbol(self.path, name, f"{owner}.{name}" if owner else name, kind, owner, signature, doc, a, b, self.complexity(first, last) if measured else None, public, entry, parameters, code, hashed(code), None))
        if kind != "class":
            self.spans.append((first, last, name))

    def calls(self, words: set[str], name) -> Iterator[tuple]:
        """(file, innermost function around, called name), once each; ``name`` makes the name that a dotted chain is called by."""
        inner, spans, seen = [], sorted(self.spans, key=lambda s: (s[0], -s[1])), set()
        at = 0
        for i in range(len(self.tokens)):
            while at < len(spans) and spans[at][0] <= i:
                inner.append(spans[at])
                at += 1
            while inner and inner[-1][1] < i:
                inner.pop()
            if not inner or self.tokens[i].kind != "name" or self.tokens[i].text in words or self.word(i - 1) in ("function", "new", "func", "class") or self.tokens[i].text[0] == "@":
                continue
            k = i + 1
            if self.is_mark(k, "<") and (after := self.angles(k)) > k and self.is_mark(after, "("):
                k = after
            if self.is_mark(k, "?.") and self.is_mark(k + 1, "("):
                k += 1
            if not self.is_mark(k, "(") or any(s[0] == i for s in self.spans) or i in self.heads:
                continue
            found = name(self.chain(i))
            if found and found != inner[-1][2] and (inner[-1][2], found) not in seen:
                seen.add((inner[-1][2], found))
                yield (self.path, inner[-1][2], found)

    heads: set[int] = frozenset()  # names that declarations give

    def chain(self, i: int) -> list[str]:
        """The names before a bracket that dots join, the last one at token i; without what isn't a name at their begin."""
        parts = [self.tokens[i].text]
        while i >= 2 and self.tokens[i - 1].text in (".", "?.") and self.tokens[i - 2].kind == "name":
            i -= 2
            parts.insert(0, self.tokens[i].text)
        return parts


# --- JavaScript and TypeScript ---------------------------------------------------------------------------------------------------


class _Script(_File):
    def __init__(self, path: str, text: str):
        super().__init__(path, text, raw_strings=False)
        self.heads = set()
        self.ends: dict[int, int] = {}  # of expressions
        self.read(0, len(self.tokens))

    def doc(self, i: int) -> str:
        """The block comment before the statement of a declaration."""
        while True:
            if self.word(i - 1) in _MODIFIERS | {"export", "default", "const", "let", "var"} or self.word(i - 1).startswith("@"):
                i -= 1
            elif i and self.is_mark(i - 1, ")") and self.word(self.opens.get(i - 1, 0) - 1).startswith("@"):
                i = self.opens[i - 1] - 1
            else:
                break
        found = re.findall(r"/\*.*?\*/", self.comments.get(i, ""), re.S)
        return "\n".join(x.strip().lstrip("*").strip() for x in found[-1][2:-2].strip("*").split("\n")).strip() if found else ""

    def exported_default(self, i: int) -> bool:
        while self.word(i - 1) in _MODIFIERS:
            i -= 1
        return self.word(i - 1) == "default" and self.word(i - 2) == "export"

    def parameters(self, first: int, last: int) -> tuple[list[str], list[str]]:
        """(as they are shown, names): with types, of defaults only that there is one."""
        shown, names = [], []
        for a, b in self.split(first, last):
            while self.word(a) in _MODIFIERS and a < b and self.tokens[a + 1].kind == "name":
                a += 1
            plain, i = b, a
            while i <= b:
                if self.is_mark(i, "="):
                    plain = i - 1
                    break
                i = max(self.match[i], i) + 1
            shown.append(self.source(a, plain) + (" = ..." if plain < b else ""))
            colon = next((k for k in range(a, plain + 1) if self.is_mark(k, ":") and (a == k - 1 or self.tokens[k - 1].text in ("?", "}", "]") or self.tokens[k - 1].kind == "name" and not self.is_mark(a, "{"))), plain + 1)
            names.append(self.source(a, colon - 1).rstrip("?"))
        return shown, names

    def returns(self, i: int, stops: tuple[str, ...]) -> tuple[int, str]:
        """(the token that ends a return type, the type): of ``: type`` after the parameters."""
        if not self.is_mark(i, ":"):
            return i, ""
        k = i + 1
        while k < min(len(self.tokens), i + 400):
            t = self.tokens[k]
            if t.kind == "mark" and t.text in stops and not (t.text == "{" and (k == i + 1 or self.tokens[k - 1].text in ("|", "&", "<", ",", "=>", ":"))):
                return k, self.source(i + 1, k - 1)
            if t.kind == "mark" and t.text in ";)" or t.kind == "name" and self.tokens[k - 1].text not in _CONTINUES | {"|", "&"} and "\n" in self.text[self.tokens[k - 1].end : t.begin]:
                break
            k = max(self.match[k] + 1, self.angles(k), k + 1)
        return i, ""

    def function(self, name_at: int, first: int, params_at: int, owner: str | None, head: str, entry: bool) -> int | None:
        """Adds a function with a body in braces; the number of its last token."""
        if not self.is_mark(params_at, "("):
            return None
        close = self.match[params_at]
        body, kind = self.returns(close + 1, ("{",))
        if not self.is_mark(body, "{"):
            return None
        last, name = self.match[body], self.tokens[name_at].text
        shown, names = self.parameters(params_at, close)
        signature = f"{head}{name}({', '.join(shown)})" + (f": {kind}" if kind else "")
        self.heads.add(name_at)
        self.add(name, "method" if owner else "function", owner, signature, self.doc(first), first, last, name[0] not in "_#", entry, names)
        return last

    def named(self, name_at: int, first: int, owner: str | None) -> int | None:
        """Adds ``name = (..) => ..`` or ``name = function ..``; the number of its last token."""
        i = name_at + 1
        if self.is_mark(i, "?") or self.is_mark(i, "!"):
            i += 1
        if self.is_mark(i, ":"):
            i, _ = self.returns(i, ("=",))
        if not self.is_mark(i, "="):
            return None
        i += 1
        head = "async " * (self.word(i) == "async" and not self.is_mark(i + 1, "=>"))
        i += bool(head)
        name = self.tokens[name_at].text
        entry = owner is None and (name.lower() in ENTRY_POINTS)
        if self.word(i) == "function":
            i += 1 + self.is_mark(i + 1, "*")
            i += bool(self.word(i))
            params_at = self.angles(i)
            if not self.is_mark(params_at, "("):
                return None
            close = self.match[params_at]
            body, kind = self.returns(close + 1, ("{",))
        else:
            params_at = self.angles(i)
            if self.is_mark(params_at, "("):
                close = self.match[params_at]
                arrow, kind = self.returns(close + 1, ("=>",))
            else:
                close, kind, arrow = params_at, "", params_at + 1
                if not self.word(params_at):
                    return None
            if not self.is_mark(arrow, "=>"):
                return None
            body = arrow + 1
        if body >= len(self.tokens):
            return None
        shown, names = self.parameters(params_at, close) if self.is_mark(params_at, "(") else ([self.word(params_at)],) * 2
        last = self.match[body] if self.is_mark(body, "{") else self.expression(body)
        signature = f"const {name} = {head}({', '.join(shown)})" + (f": {kind}" if kind else "") + " => ..."
        self.heads.add(name_at)
        self.add(name, "method" if owner else "function", owner, signature, self.doc(first), first, last, name[0] not in "_#", entry, names)
        return last

    def expression(self, i: int) -> int:
        """The last token of an expression: before a comma, a semicolon, a closing bracket, or a new line that can't go on."""
        last, seen = i, []
        while i < len(self.tokens):
            if i in self.ends:  # been here from an earlier token
                last = self.ends[i]
                break
            t = self.tokens[i]
            if t.kind == "mark" and t.text in (";", ",", ")", "]", "}"):
                break
            if i > last and "\n" in self.text[self.tokens[last].end : t.begin] and not (t.text in _CONTINUES or self.tokens[last].text in _CONTINUES):
                break
            seen.append(i)
            last = self.match[i]
            i = last + 1
        self.ends |= dict.fromkeys(seen, last)
        return last

    def class_(self, i: int) -> int | None:
        name = self.word(i + 1)
        if not name or name in ("extends", "implements"):
            return None
        body = i + 2
        while body < len(self.tokens) and not self.is_mark(body, "{"):
            if self.tokens[body].text in (";", "}", ")") or self.word(body) in ("class", "function", "const", "let", "var", "import", "export"):
                return None
            body = max(self.match[body] + 1, self.angles(body), body + 1)
        if body >= len(self.tokens):
            return None
        base = self.source(self.angles(i + 2), body - 1)
        place, last = len(self.symbols), self.match[body]
        self.members(name, body + 1, last)
        methods = [s.symbol_name for s in self.symbols[place:] if not s.signature.startswith("const ")]
        self.add(name, "class", None, f"class {name}" + (f" {base}" if base else ""), self.doc(i), i, last, name[0] != "_", self.exported_default(i), methods, measured=False)
        self.symbols.insert(place, self.symbols.pop())
        return last

    def members(self, owner: str, i: int, end: int) -> None:
        while i < end:
            while self.word(i).startswith("@"):  # a decorator, with what it is called with
                i += 1
                while self.is_mark(i, "."):
                    i += 2
                i = self.match[i] + 1 if self.is_mark(i, "(") else i
            first, marks = i, []
            while self.word(i) in _MODIFIERS and i + 1 < end and not (self.tokens[i + 1].text in ("(", "=", ":", "?", "!", ";", "<")):
                marks.append(self.word(i))
                i += 1
            i += self.is_mark(i, "*")
            if self.word(i) and (last := self.function(i, first, self.angles(i + 1), owner, "".join(f"{m} " for m in ("set", "get", "static", "async") if m in marks), False) or self.named(i, first, owner)):
                i = last + 1
                continue
            if i < end:  # whatever else: to its end
                while i < end and not self.is_mark(i, ";"):
                    after = max(self.match[i] + 1, i + 1)
                    closed, i = self.is_mark(i, "{"), after
                    if closed or i < end and "\n" in self.text[self.tokens[i - 1].end : self.tokens[i].begin] and self.tokens[i - 1].text not in _CONTINUES and self.tokens[i].text not in _CONTINUES:
                        break
                i += self.is_mark(i, ";")

    def read(self, i: int, end: int) -> None:
        while i < end:
            word, before = self.word(i), self.tokens[i - 1].text if i else ""
            if word == "function" and before != ".":
                name_at = i + 1 + self.is_mark(i + 1, "*")
                declared = i == 0 or before in ("{", "}", ";", ")", "export", "default", "async", "else", ":") or "\n" in self.text[self.tokens[i - 1].end : self.tokens[i].begin] and before not in _CONTINUES | {"(", "[", "return"}
                if self.word(name_at) and declared:
                    first = i - (before == "async")
                    name = self.word(name_at)
                    entry = name.lower() in ENTRY_POINTS or self.exported_default(first)
                    self.function(name_at, first, self.angles(name_at + 1), None, "async " * (before == "async") + "function ", entry)
            elif word in ("const", "let", "var") and before != ".":
                k = i + 1
                while self.word(k):
                    last = self.named(k, k if k > i + 1 else i + 1, None)
                    k = self.tail(last if last is not None else k)
                    if not self.is_mark(k, ","):
                        break
                    k += 1
            elif word == "class" and before != "." and (last := self.class_(i)) is not None:
                i = last
            i += 1

    def tail(self, i: int) -> int:
        """What follows a declarator."""
        return self.expression(i) + 1

    def imports(self) -> Iterator[tuple]:
        seen = set()
        for i, t in enumerate(self.tokens):
            if t.kind != "name" or t.text not in ("import", "export", "require", "from") or i and self.tokens[i - 1].text == ".":
                continue
            k = i + 1
            if t.text in ("require", "import") and self.is_mark(k, "("):
                k += 1
            elif t.text in ("require", "export"):
                continue
            if k < len(self.tokens) and self.tokens[k].kind == "string" and (t.text != "from" or self.statement(i)):
                module = self.tokens[k].text[1:-1]
                if module not in seen:
                    seen.add(module)
                    yield (self.path, module)

    def statement(self, i: int) -> bool:
        """Whether a ``from`` belongs to an import or export."""
        for k in range(i - 1, max(-1, i - 2000), -1):
            if self.word(k) in ("import", "export"):
                return True
            if self.tokens[k].text in (";", "(", "=") or self.tokens[k].kind == "string":
                return False
        return False


# --- Go --------------------------------------------------------------------------------------------------------------------------


class _Go(_File):
    def __init__(self, path: str, text: str):
        super().__init__(path, text, raw_strings=True)
        self.heads = set()
        for i in range(len(self.tokens)):
            if self.word(i) == "func":
                self.function(i)
            elif self.word(i) == "type" and self.is_mark(i + 1, "("):
                k, end = i + 2, self.match[i + 1]
                while k < end:
                    k = self.type_(k, k) or self.match[k] + 1
            elif self.word(i) == "type":
                self.type_(i + 1, i)

    def doc(self, i: int) -> str:
        return "\n".join(line.strip()[2:].strip() for line in self.comments.get(i, "").split("\n") if line.strip().startswith("//"))

    def names(self, first: int, last: int) -> tuple[list[str], list[str]]:
        """(parameters as they are shown, their names); of types alone no names."""
        parts = self.split(first, last)
        named = any(b > a and self.word(a) and self.tokens[a + 1].text not in (".", "[") for a, b in parts)
        shown = [self.source(a, b) for a, b in parts]
        return shown, [self.word(a) for a, b in parts] if named else []

    def function(self, i: int) -> None:
        owner, k = None, i + 1
        if self.is_mark(k, "("):
            if self.match[k] > k + 50:  # no receiver
                return
            plain = next((j for j in range(k + 1, self.match[k]) if self.is_mark(j, "[")), self.match[k])
            inner = [t.text for t in self.tokens[k + 1 : plain] if t.kind == "name"]
            owner, k = (inner[-1] if inner else None), self.match[k] + 1
            if owner is None:
                return
        name_at = k
        name = self.word(name_at)
        if not name:
            return
        k = self.match[k + 1] + 1 if self.is_mark(k + 1, "[") else k + 1
        if not self.is_mark(k, "("):
            return
        close = self.match[k]
        body = close + 1
        while body < len(self.tokens) and not (self.is_mark(body, "{") and self.word(body - 1) not in ("interface", "struct")):
            if "\n" in self.text[self.tokens[body - 1].end : self.tokens[body].begin]:
                return  # declared without a body
            body = self.match[body] + 1
        if body >= len(self.tokens):
            return
        shown, names = self.names(k, close)
        kind = self.source(close + 1, body - 1)
        self.heads.add(name_at)
        entry = name == "main" or name.startswith(("Test", "Benchmark"))
        self.add(name, "method" if owner else "function", owner, f"func {name}({', '.join(shown)})" + (f" {kind}" if kind else ""), self.doc(i), i, self.match[body], name[0].isupper(), entry, names)

    def type_(self, i: int, first: int) -> int | None:
        """Adds a struct or an interface; what follows it."""
        name, k = self.word(i), i + 1
        if self.is_mark(k, "[") and not self.is_mark(k + 1, "]"):
            k = self.match[k] + 1
        kind = self.word(k)
        if not name or kind not in ("struct", "interface") or not self.is_mark(k + 1, "{"):
            return None
        last, fields, j = self.match[k + 1], [], k + 2
        while j < last and kind == "struct":
            begin = j
            while j < last and (j == begin or "\n" not in self.text[self.tokens[j - 1].end : self.tokens[j].begin]) and not self.is_mark(j, ";"):
                j = self.match[j] + 1
            row = self.tokens[begin:j]
            if len(row) > 1 and row[0].kind == "name" and row[1].text != ".":
                n = 0
                while n < len(row) and row[n].kind == "name":
                    fields.append(row[n].text)
                    if n + 1 >= len(row) or row[n + 1].text != ",":
                        break
                    n += 2
            j += self.is_mark(j, ";")
        self.add(name, "class", None, f"type {name} {kind}", self.doc(first), i, last, name[0].isupper(), False, fields, measured=False)
        return last + 1

    def imports(self) -> Iterator[tuple]:
        seen, i = set(), 0
        while i < len(self.tokens):
            first, last = i + 1, i + 2
            if self.word(i) == "import":
                if grouped := self.is_mark(first, "("):
                    last = self.match[first]
                found = [t.text[1:-1] for t in self.tokens[first : last + 1] if t.kind == "string"][: None if grouped else 1]
                yield from ((self.path, m) for m in dict.fromkeys(found) if m not in seen)
                seen |= set(found)
                i = last
            i += 1


def _script_name(parts: list[str]) -> str:
    """``this.x`` is x; longer chains stay as they are."""
    return parts[1] if len(parts) == 2 and parts[0] == "this" else ".".join(parts)


def read_script(path: str, text: str) -> tuple[list[Symbol], list[tuple], list[tuple]]:
    f = _Script(path, text)
    return f.symbols, list(f.calls(_WORDS, _script_name)), list(f.imports())


def read_go(path: str, text: str) -> tuple[list[Symbol], list[tuple], list[tuple]]:
    f = _Go(path, text)
    return f.symbols, list(f.calls(_GO_WORDS, lambda parts: parts[-1])), list(f.imports())
