"""C8 for Lua and Racket: small readers that give the spans of statements or expressions, and their categories.

Both return the struct of blocks.BLOCKS as a dict. Code that can't be read has ok = false and keeps the blocks found before the place.
"""

from __future__ import annotations

import re

from loomtext.operators.block_struct import blank

# ---- Racket --------------------------------------------------------------------------------------------------------------
RACKET = re.compile(r"""(?P<skip>\s+|;[^\n]*|\#\|.*?\|\#)|(?P<lang>\#lang[^\n]*|\#reader[^\n]*)|(?P<drop>\#;)|(?P<open>\#?[(\[{])|(?P<close>[)\]}])|(?P<mark>\#?(?:'|`|,@|,))|(?P<string>\#?(?:rx|px)?"(?:\\.|[^"\\])*")|(?P<atom>\#\\[^\s]|[^\s()\[\]{}";'`,]+)""", re.DOTALL)
NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+|/\d+)?")
PAIRS = {"(": ")", "[": "]", "{": "}"}


class _Form:
    """An expression: its kind, span and, for a list, its parts."""

    __slots__ = ("end", "kind", "parts", "start")

    def __init__(self, kind: str, start: int, end: int = 0):
        self.kind, self.start, self.end, self.parts = kind, start, end, []


def _racket_forms(code: str) -> tuple[list[_Form], bool]:
    root = _Form("list", 0)
    open_: list[tuple[_Form, str]] = []
    marked: list[tuple[int, int]] = []  # (depth, start) of quote marks that wait for their expression
    dropped: list[int] = []
    at = 0

    def add(form: _Form) -> None:
        depth = len(open_)
        if marked and marked[-1][0] == depth:
            form = _Form("quote", marked.pop()[1], form.end)
            while marked and marked[-1][0] == depth:
                form.start = marked.pop()[1]
        if dropped and dropped[-1] == depth:
            dropped.pop()
        else:
            (open_[-1][0] if open_ else root).parts.append(form)

    while at < len(code):
        match = RACKET.match(code, at)
        if not match:
            return root.parts, False
        kind, text, start = match.lastgroup, match[0], at
        at = match.end()
        if kind == "open":
            open_.append((_Form("list" if len(text) == 1 else "vector", start), PAIRS[text[-1]]))
        elif kind == "close":
            if not open_ or open_[-1][1] != text:
                return root.parts, False
            form = open_.pop()[0]
            form.end = at
            add(form)
        elif kind == "mark":
            marked.append((len(open_), start))
        elif kind == "drop":
            dropped.append(len(open_))
        elif kind != "skip":
            add(_Form(kind if kind != "atom" else "other" if text[0] == "#" or NUMBER.fullmatch(text) else "symbol", start, at))
    return root.parts, not open_ and not marked


def racket_blocks(code: str | None) -> dict:
    """define with a signature is a function, whose body is entered; other defines and lets are assignments, and lets' bodies are entered; every other expression is whole."""
    out = blank(code is not None)
    forms, ok = _racket_forms(code or "")
    out["ok"] = ok and code is not None
    waiting = list(reversed(forms))
    while waiting:
        form = waiting.pop()
        text = code[form.start : form.end]
        if form.kind != "list":
            out["others"].append(text)
            continue
        if not form.parts:
            continue
        head = form.parts[0]
        word = code[head.start : head.end] if head.kind == "symbol" else ""
        if word == "define" and len(form.parts) > 1 and form.parts[1].kind == "list":
            sign = form.parts[1]
            out["function_def"].append(f"(define {code[sign.start : sign.end]} ...)")
            waiting += reversed(form.parts[2:])
        elif word == "define":
            out["assignments"].append(text)
        elif "let" in word:
            out["assignments"].append(text)
            waiting += reversed(form.parts[2:])
        else:
            out["loops" if "for" in word else "conditionals" if word in ("if", "cond") else "others"].append(text)
    return out


# ---- Lua -----------------------------------------------------------------------------------------------------------------
LUA = re.compile(r"""(?P<skip>\s+|--\[(?P<c>=*)\[.*?\](?P=c)\]|--[^\n]*)|(?P<value>\[(?P<s>=*)\[.*?\](?P=s)\]|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|0[xX][\da-fA-F.]+(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*)|(?P<symbol>\.\.\.|\.\.|::|==|~=|<=|>=|<<|>>|//|[-+*/%^\#&~|<>=(){}\[\];:,.])""", re.DOTALL)
KEYWORDS = frozenset("and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split())
BINARY = frozenset("+ - * / // % ^ .. == ~= <= >= < > and or & | ~ << >>".split())
ENDS = frozenset(["end", "else", "elseif", "until", ""])


class _Unreadable(Exception):
    pass


class _Lua:
    """A recursive reader; found is filled in page order."""

    def __init__(self, code: str):
        self.code, self.found = code, blank(True)
        self.tokens: list[tuple[str, str, int, int]] = []
        at = 0
        while at < len(code):
            match = LUA.match(code, at)
            if not match:
                raise _Unreadable
            kind = match.lastgroup if match.lastgroup not in ("c", "s") else "skip" if match["skip"] else "value"
            if kind != "skip":
                self.tokens.append((kind, match[0], at, match.end()))
            at = match.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.tokens[at][1] if at < len(self.tokens) and self.tokens[at][0] != "value" else "" if at >= len(self.tokens) else "\0"

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> tuple[str, str, int, int]:
        if self.at >= len(self.tokens) or wanted is not None and self.peek() != wanted:
            raise _Unreadable
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> None:
        if self.kind() != "name" or self.peek() in KEYWORDS:
            raise _Unreadable
        self.at += 1

    def text(self, first: int) -> str:
        return self.code[self.tokens[first][2] : self.tokens[self.at - 1][3]]

    # Statements: each method reads one; `seen` collects what is to be categorised, as functions to call in page order.
    def block(self, seen: list) -> tuple[int, int]:
        """The span of the statements up to a word that ends a block; equal numbers if there are none."""
        first = self.at
        while self.peek() not in ENDS:
            last = self.peek() == "return"
            self.statement(seen)
            if last:
                break
        return first, self.at

    def add(self, kind: str, first: int) -> None:
        text = self.text(first)
        return lambda: self.found[kind].append(text)

    def statement(self, seen: list) -> None:
        first, word = self.at, self.peek()
        if word == ";":
            self.at += 1
        elif word == "function" or word == "local" and self.peek(1) == "function":
            self.at += 1 + (word == "local")
            self.name()
            while self.peek() in (".", ":"):
                self.at += 1
                self.name()
            self.body(seen, first)
        elif word == "local":
            self.at += 1
            self.names()
            if self.peek() == "=":
                self.at += 1
                self.expressions([])
            seen.append(self.add("assignments", first))
        elif word in ("for", "while", "repeat"):
            self.loop(seen, first, word)
        elif word == "if":
            self.condition(seen, first)
        elif word == "do":
            self.at += 1
            self.block(seen)
            self.take("end")
        elif word == "return":
            self.at += 1
            if self.peek() not in ENDS and self.peek() != ";":
                self.expressions(seen)
            if self.peek() == ";":
                self.at += 1
            seen.append(self.add("others", first))
        elif word in ("break", "goto", "::"):
            self.at += 1
            if word != "break":
                self.name()
            if word == "::":
                self.take("::")
        else:
            inner: list = []
            self.expression(inner, calls_only=True)
            if self.peek() in (",", "="):
                while self.peek() == ",":
                    self.at += 1
                    self.expression([], calls_only=True)
                self.take("=")
                self.expressions([])
                seen.append(self.add("assignments", first))
            else:
                seen += inner

    def names(self) -> None:
        while True:
            self.name()
            if self.peek() == "<":  # an attribute
                self.at += 1
                self.name()
                self.take(">")
            if self.peek() != ",":
                return
            self.at += 1

    def loop(self, seen: list, first: int, word: str) -> None:
        inner: list = []
        self.at += 1
        if word == "for":
            self.names()
            if self.take()[1] not in ("=", "in"):
                raise _Unreadable
            self.expressions([])
        elif word == "while":
            self.expression([])
        if word != "repeat":
            self.take("do")
        self.block(inner)
        self.take("until" if word == "repeat" else "end")
        if word == "repeat":
            self.expression([])
        seen += [self.add("loops", first), *inner]

    def condition(self, seen: list, first: int) -> None:
        """The first branch that has statements is entered, the others are not."""
        branches: list[list] = []
        filled: list[bool] = []
        while True:
            word = self.take()[1]
            if word in ("if", "elseif"):
                self.expression([])
                self.take("then")
            branches.append([])
            a, b = self.block(branches[-1])
            filled.append(b > a)
            if self.peek() not in ("elseif", "else"):
                break
        self.take("end")
        seen.append(self.add("conditionals", first))
        if any(filled):
            seen += branches[filled.index(True)]

    def body(self, seen: list, first: int) -> None:
        """Parameters, statements and end of a function that began at token `first`."""
        self.take("(")
        while self.peek() != ")":
            if self.peek() == "...":
                self.at += 1
            else:
                self.name()
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != ")":
                raise _Unreadable
        self.at += 1
        inner: list = []
        a, b = self.block(inner)
        held = self.code[self.tokens[a][2] : self.tokens[b - 1][3]] if b > a else None
        self.take("end")
        whole = self.text(first)
        decl = whole if held is None else whole.replace(held, "{}")
        seen += [lambda: self.found["function_def"].append(decl), *inner]

    # Expressions: functions in them are put to `seen`.
    def expressions(self, seen: list) -> None:
        self.expression(seen)
        while self.peek() == ",":
            self.at += 1
            self.expression(seen)

    def expression(self, seen: list, calls_only: bool = False) -> None:
        while True:
            while not calls_only and self.peek() in ("not", "-", "#", "~"):
                self.at += 1
            self.primary(seen)
            if calls_only or self.peek() not in BINARY:
                return
            self.at += 1

    def primary(self, seen: list) -> None:
        kind, word = self.kind(), self.peek()
        if kind == "value" or word in ("nil", "true", "false", "..."):
            self.at += 1
        elif word == "function":
            first = self.at
            self.at += 1
            self.body(seen, first)
            return
        elif word == "{":
            self.table(seen)
        elif word == "(":
            self.at += 1
            self.expression(seen)
            self.take(")")
        else:
            self.name()
        while True:
            word = self.peek()
            if word == "." or word == ":":
                self.at += 1
                self.name()
            elif word == "[":
                self.at += 1
                self.expression(seen)
                self.take("]")
            elif word == "(":
                self.at += 1
                if self.peek() != ")":
                    self.expressions(seen)
                self.take(")")
            elif word == "{":
                self.table(seen)
            elif word == "\0" and self.tokens[self.at][1][0] in "\"'[":
                self.at += 1
            else:
                return

    def table(self, seen: list) -> None:
        self.take("{")
        while self.peek() != "}":
            if self.peek() == "[":
                self.at += 1
                self.expression(seen)
                self.take("]")
                self.take("=")
            elif self.kind() == "name" and self.peek(1) == "=":
                self.at += 2
            self.expression(seen)
            if self.peek() in (",", ";"):
                self.at += 1
            elif self.peek() != "}":
                raise _Unreadable
        self.at += 1


def lua_blocks(code: str | None) -> dict:
    """Functions (their bodies as {}) and loops are entered, of conditionals the first branch; functions within calls and returns count, those assigned don't; calls are in no category."""
    if code is None:
        return blank(False)
    seen: list = []
    try:
        reader = _Lua(code)
    except _Unreadable:
        return blank(False)
    try:
        reader.block(seen)
        whole = reader.at == len(reader.tokens)
    except (_Unreadable, RecursionError):
        whole = False
    for add in seen:
        add()
    return reader.found | {"ok": whole}
