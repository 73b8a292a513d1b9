"""Tokens of languages with braces: names, numbers, strings, regular expressions, templates with code inside, and punctuation.

A token is (kind, text, begin, end). What a slash begins depends on the token before it; what a closing brace ends (a block or the
code within a template) on a stack. Comments are no tokens; those that a declaration may have as its text are kept aside. Each
character is looked at a bounded number of times: a quote that nothing closes on its line is remembered as such.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, regex, template, mark
    text: str
    begin: int
    end: int


_NAME = r"[^\W\d][\w$]*|[$#@][\w$]*"
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(
    rf"(?P<comment>//[^\n]*|/\*)|(?P<name>{_NAME})|(?P<number>\d[\w.]*)"
    r"|(?P<mark>=>|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\.\.\.|:=|<-|[-+*/%&|^!=<>]=+|\+\+|--|[^\w\s])"
)
_QUOTED = {"'": re.compile(r"'(?:[^'\\\n]|\\[\s\S])*'"), '"': re.compile(r'"(?:[^"\\\n]|\\[\s\S])*"')}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
#: Words that an expression follows, so that a slash after them begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof"}


def tokens(text: str, raw_strings: bool = False) -> tuple[list[Token], dict[int, str]]:
    """The tokens, and by the number of a token the comments right before it. With ``raw_strings`` back quotes hold no code, and slashes begin no expression."""
    out: list[Token] = []
    comments: dict[int, str] = {}
    closing: list[bool] = []  # for each open brace: whether it is within a template
    dead = {"'": -1, '"': -1, "/": -1}  # up to here none is closed
    i, n = 0, len(text)

    def template(at: int) -> int:
        """The end of a template's text from here on, which a back quote or the begin of code ends."""
        end = _TEMPLATE.match(text, at).end()
        if text.startswith("${", end):
            closing.append(True)
            out.append(Token("mark", "{", end + 1, end + 2))
            return end + 2
        return min(n, end + 1)

    def quoted(c: str, pattern: re.Pattern, kind: str) -> bool:
        nonlocal i
        if i < dead[c]:
            return False
        if found := pattern.match(text, i):
            out.append(Token(kind, found.group(), i, found.end()))
            i = found.end()
            return True
        line = text.find("\n", i)
        dead[c] = n if line < 0 else line
        return False

    while i < n:
        if found := _SPACE.match(text, i):
            i = found.end()
            continue
        c = text[i]
        if c in _QUOTED and quoted(c, _QUOTED[c], "string"):
            continue
        if c == "`":
            begin = i
            if raw_strings:
                end = text.find("`", i + 1)
                i = n if end < 0 else end + 1
                out.append(Token("string", text[begin:i], begin, i))
            else:
                out.append(Token("template", "`", i, i + 1))
                i = template(i + 1)
            continue
        before = out[-1] if out else None
        if c == "/" and not raw_strings and text[i + 1 : i + 2] not in ("/", "*"):
            free = before is None or before.kind == "mark" and before.text not in (")", "]", "++", "--") or before.kind == "name" and before.text in _BEFORE_REGEX
            if free and quoted("/", _REGEX, "regex"):
                continue
        found = _TOKEN.match(text, i)
        if found is None:  # a mark between letters and digits of no known class
            i += 1
            continue
        kind = found.lastgroup
        if kind == "comment":
            end = found.end()
            if found.group() == "/*":
                end = text.find("*/", i + 2)
                end = n if end < 0 else end + 2
            comments[len(out)] = comments[len(out)] + "\n" + text[i:end] if len(out) in comments else text[i:end]
            i = end
            continue
        i = found.end()
        if kind == "mark" and c == "{":
            closing.append(False)
        elif kind == "mark" and c == "}" and closing and closing.pop():
            out.append(Token("mark", "}", found.start(), i))
            i = template(i)
            continue
        out.append(Token(kind, found.group(), found.start(), i))
    return out, comments


def brackets(out: list[Token]) -> list[int]:
    """For each token that opens a bracket the number of the one that closes it, or of the last token; for others their own."""
    match, open_ = list(range(len(out))), []
    pairs = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(out):
        if t.kind == "mark" and t.text in "([{":
            open_.append(i)
        elif t.kind == "mark" and t.text in pairs:
            at = len(open_) - 1
            if at >= 0 and out[open_[at]].text != pairs[t.text]:  # of what isn't balanced the last one that fits, among a few
                at = next((k for k in range(at - 1, max(-1, at - 9), -1) if out[open_[k]].text == pairs[t.text]), -1)
            if at >= 0:
                for k in open_[at:]:
                    match[k] = i
                del open_[at:]
    for k in open_:
        match[k] = len(out) - 1
    return match
