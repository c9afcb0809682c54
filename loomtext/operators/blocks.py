"""Structural blocks of code: category lists of statements, from a parser or from tokens.

Everything returns a struct (ok, function_def[], loops[], conditionals[], assignments[], others[]), whatever the language. Parsers run in
Arrow-batched pandas UDFs; broken code gives ok = false and never fails a task.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as t
from loomtext.operators.block_readers import lua_blocks, racket_blocks
from loomtext.operators.block_struct import BLOCKS, KINDS, blank

def _kind(node: ast.stmt) -> str:
    if isinstance(node, ast.For | ast.While):
        return "loops"
    if isinstance(node, ast.If):
        return "conditionals"
    return "assignments" if isinstance(node, ast.Assign) else "others"


def python_blocks(code: str | None, nested: bool = True) -> dict:
    """C1 (nested: functions within functions are entered) and C2 (only the outermost statements; the last function's line alone)."""
    try:
        body = ast.parse(code).body
        out = blank(True)
        waiting = list(reversed(body))
        while waiting:
            node = waiting.pop()
            inside = isinstance(node, tuple)
            node = node[0] if inside else node
            source = ast.get_source_segment(code, node)
            if isinstance(node, ast.FunctionDef) and (nested or not inside):
                line = source.split("\n")[0]
                out["function_def"] = [*out["function_def"], line] if nested else [line]
                waiting += [x if nested else (x,) for x in reversed(node.body)]
            elif source:
                out[_kind(node)].append(source)
        return out
    except Exception:  # whatever a parser meets: syntax, null bytes, depth
        return blank(False)


def python_statements(code: str) -> tuple[list[str], bool]:
    """The statements of the leading function's body, or of the module; lines with text if there is no parse."""
    try:
        body = ast.parse(code).body
        if body and isinstance(body[0], ast.FunctionDef):
            body = body[0].body
        found, ok = [s for n in body if (s := ast.get_source_segment(code, n))], True
    except Exception:
        found, ok = [x.strip() for x in code.strip().split("\n") if x.strip()], False
    return found or [code.strip()], ok


def python_tokens(code: str) -> list[str]:
    """C4: tokens without comments and line ends; white-space parts of what was left where the lexer fails."""
    skipped = {tokenize.ENCODING, tokenize.ENDMARKER, tokenize.NL, tokenize.NEWLINE, tokenize.COMMENT}
    try:
        return [x.string for x in tokenize.generate_tokens(io.StringIO(code).readline) if x.type not in skipped]
    except (tokenize.TokenError, SyntaxError):
        return code.split()


def braced_statements(tokens: list[str]) -> list[str]:
    """C5, Java and PHP: cut after `;` outside parentheses and after `{`, which is closed at once; what follows the last cut goes."""
    out, own, depth = [], [], 0
    for x in tokens:
        depth += (x == "(") - (x == ")")
        own.append(x)
        if x == "}":
            own = []
        elif x == "{" or x == ";" and not depth:
            out.append(" ".join(own) + (" }" if x == "{" else ""))
            own = []
    return out


# Tokens beside which no statement of the token-list splitters ends.
GLUE = frozenset("= + - * / % ^ ~ ! | & < > == += -= *= /= %= ^= ~= != || && <= >= . , : ( { [".split())
# By language, more such tokens; words that hold a statement open for one more token; words that begin a header.
DIALECTS = {
    "python": (GLUE | frozenset("and or not is in as".split()), ("return", "for while", "if elif else", "try except Exception raise", "assert", "with", "print", "yield"), ("def", "class")),
    "go": (GLUE | frozenset(":= ; range".split()), ("return", "for while", "defer", "var", "switch"), ("func",)),
    "ruby": (GLUE | frozenset(":= << >> ; :: do".split()), ("return", "for while", "if"), ("def",)),
}
#: What nests: Go's braces end headers instead.
NESTING = {"python": "([{", "go": "([", "ruby": "([{"}
CLOSING = dict(zip(")]}", "([{", strict=True))


class _Cutter:
    """One pass over a list of tokens, collecting the spans of statements."""

    def __init__(self, tokens: list[str], language: str):
        self.tokens, self.language = tokens, language
        self.glue, groups, self.headers = DIALECTS[language]
        self.group_of = {word: g for g in groups for word in g.split()}
        self.held = dict.fromkeys(groups, 0)
        self.depth = self.start = 0
        self.quoted = self.header = False
        self.spans: list[tuple[int, int]] = []

    def cut(self, at: int) -> None:
        self.spans.append((self.start, at))
        self.start = at + 1

    def boundary(self, at: int, token: str) -> bool:
        """Take what ends a header or a body; true if the token needs nothing more."""
        level = self.depth - (self.language == "ruby" and token == ")")
        mark = {"python": ":", "go": "{", "ruby": ")"}[self.language]
        if token == mark and level == 0 and (self.header or self.language != "ruby"):
            self.depth, self.header = level, False
            self.cut(at)
            return True
        if token == {"go": "}", "ruby": "end"}.get(self.language):
            self.start = at + 1
            return True
        return False

    def nest(self, token: str) -> None:
        opening = NESTING[self.language]
        if token in opening:
            self.depth += 1
        elif CLOSING.get(token, "none") in opening:
            self.depth -= 1
        elif self.language == "python" and token == '"':  # never closed again, as quotes come without their partners
            self.depth += 1
        elif self.language == "python" and token == "'" and (self.quoted or self.depth == 0):
            self.depth += -1 if self.quoted else 1
            self.quoted = not self.quoted

    def waits(self) -> bool:
        """Whether a word holds the statement open: it does for the token after it too."""
        for group, n in self.held.items():
            if n == 1:
                self.held[group] = 2
                return True
            if n == 2:
                self.held[group] = 0
        return False

    def run(self) -> list[tuple[int, int]]:
        last = len(self.tokens) - 1
        for at, token in enumerate(self.tokens):
            if token in self.headers:
                self.header = True
                if self.language == "ruby":
                    continue
            if token in self.group_of:
                self.held[self.group_of[token]] += 1
            if self.boundary(at, token):
                continue
            self.nest(token)
            if self.language == "ruby" and at == 2 and token != "(" and self.header:  # a method without parameters
                self.cut(at)
                self.start, self.header = at, False
            elif self.depth == 0 and at == last:
                self.cut(at)
            elif self.depth == 0 and not self.waits() and not self.header and not {token, self.tokens[at + 1]} & self.glue:
                self.cut(at)
        return self.spans


def token_statements(tokens: list[str], language: str) -> list[str]:
    """The statements of a list of tokens, each joined by spaces: java, php, python, go, ruby.

    A bare `return` or `if` also takes the statement after it, which stands by itself too. A statement that ends in `{` is closed (not in Python).
    """
    if language in ("java", "php"):
        return braced_statements(tokens)
    spans, out = _Cutter(tokens, language).run(), []
    for i, (start, end) in enumerate(spans):
        own = tokens[start : end + 1]
        if own in (["return"], ["if"]) and i + 1 < len(spans):
            own = tokens[start : spans[i + 1][1] + 1]
        out.append(" ".join(own) + (" }" if language != "python" and own and own[-1] == "{" else ""))
    return out


def split_token_lists(tokens: Column, language: str) -> Column:
    """token_statements() of an array column."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else token_statements(list(x), language))

    return run(tokens)


# Words that open a block of the Julia splitter, and the category of the block.
JULIA_OPENERS = {"function": "function_def", "for": "loops", "while": "loops", "if": "conditionals", "try": "conditionals"}
JULIA_CONTINUED = ("elseif", "else", "catch", "finally")
JULIA_SPLIT = ("function", "for", "while", "if", "try", "catch", "elseif", "else", "end")


def julia_lines(code: str) -> list[str]:
    """Statements on lines of their own: cut at semicolons and around block words, one word after the other."""
    text = "\n".join(x.strip() for x in code.split(";"))
    for word in JULIA_SPLIT:
        for before, after in ((f" {word} ", f"\n{word}\n"), (f" {word}(", f"\n{word}("), (f"){word} ", f"){word}\n"), (f"{word} ", f"{word}\n")):
            text = text.replace(before, after)
    return [x for line in text.splitlines() if (x := line.strip())]


def julia_blocks(code: str | None) -> dict:
    """Blocks of Julia code that no parser takes; blocks left open are closed at the end, the innermost first."""
    out = blank(code is not None)
    open_: list[tuple[str, list[str]]] = []

    def close() -> None:
        kind, lines = open_.pop()
        if text := "\n".join(lines).strip():
            out[kind].append(text)

    for line in julia_lines(code or ""):
        kind = next((k for w, k in JULIA_OPENERS.items() if line == w or line.startswith((w + " ", w + "("))), None)
        if kind:
            open_.append((kind, [line]))
        elif open_ and line.startswith(JULIA_CONTINUED):
            open_[-1][1].append(line)
        elif line == "end" and open_:
            open_[-1][1].append(line)
            close()
        elif open_:
            open_[-1][1].append(line)
        else:
            name = line.split("=")[0].strip().replace(".", "").replace("_", "")
            assigned = line != "end" and "=" in line and not line.startswith("=") and name.isalnum()
            out["assignments" if assigned else "others"].append(line)
    while open_:
        close()
    return out


def _struct_udf(split: Callable[[str | None], dict]):
    @F.pandas_udf(BLOCKS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for codes in parts:
            yield pd.DataFrame([split(c) for c in codes], columns=["ok", *KINDS])

    return run


#: Splitters by language. Others are registered by whoever has a parser: a callable from code to a struct as above.
SPLITTERS: dict[str, Callable[[str | None], dict]] = {
    "python": python_blocks, "python-outer": partial(python_blocks, nested=False), "julia-broken": julia_blocks, "lua": lua_blocks, "racket": racket_blocks,
}


def split_blocks(code: Column, lang: str = "python") -> Column:
    """C1, C2 (python-outer), C8 (lua, racket), C9 (julia-broken): the blocks of each code; an error names languages without a splitter."""
    if lang not in SPLITTERS:
        raise NotImplementedError(f"no splitter is registered for {lang!r}")
    return _struct_udf(SPLITTERS[lang])(code)


def split_statements(code: Column) -> Column:
    """struct(statements, ok) of Python code; null code counts as empty."""

    @F.pandas_udf("statements array<string>, ok boolean")
    def run(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([python_statements(c or "") for c in codes], columns=["statements", "ok"])

    return run(code)


def lex(code: Column) -> Column:
    """C4: the tokens of Python code; null code counts as empty."""

    @F.pandas_udf("array<string>")
    def run(codes: pd.Series) -> pd.Series:
        return pd.Series([python_tokens(c or "") for c in codes], dtype=object)

    return run(code)


def syntax_check(code: Column) -> Column:
    """struct(valid, message, type); any error of the parser counts."""

    @F.pandas_udf("valid boolean, message string, type string")
    def run(codes: pd.Series) -> pd.DataFrame:
        rows = []
        for c in codes:
            try:
                ast.parse(c)
                rows.append((True, None, None))
            except Exception as e:
                rows.append((False, str(e), type(e).__name__))
        return pd.DataFrame(rows, columns=["valid", "message", "type"])

    return run(code)


def structural_rows(df: DataFrame, code: str, lang: str = "python") -> DataFrame:
    """Df with the blocks' lists and cleaned_seqs, their texts squeezed and lower-cased in order of category; all null for empty code."""
    rows = df.withColumn("_b", split_blocks(F.col(code), lang))
    some = F.coalesce(F.col(code), F.lit("")) != ""
    seqs = F.filter(F.transform(F.concat(*(F.col(f"_b.{k}") for k in KINDS)), t.block_text), lambda x: x != "")
    return rows.select(*df.columns, F.when(some, F.col("_b.ok")).alias("ast_ok"), F.when(some, seqs).alias("cleaned_seqs"), *(F.when(some, F.col(f"_b.{k}")).alias(k) for k in KINDS))


def block_statistics(rows: DataFrame) -> DataFrame:
    """One row: total, ast_failed, no_seqs, only_function_def, and their rates to four places."""
    n_seqs = F.coalesce(F.size("cleaned_seqs"), F.lit(0))
    n_seqs = F.when(F.col("cleaned_seqs").isNull(), 0).otherwise(n_seqs)
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.coalesce("ast_ok", F.lit(True))).alias("ast_failed"),
        F.count_if(n_seqs == 0).alias("no_seqs"),
        F.count_if(F.coalesce("ast_ok", F.lit(False)) & (n_seqs > 0) & (n_seqs == F.size("function_def"))).alias("only_function_def"),
    )
    return counts.select("*", *(F.bround(F.try_divide(F.col(c).cast("double"), F.col("total").cast("double")), 4).alias(f"{c}_rate") for c in ("ast_failed", "no_seqs", "only_function_def")))


def parse_rate(df: DataFrame, code: str, sample_count: int | None = None) -> DataFrame:
    """A5: the share in percent of codes that parse, of sample_count rows or of all."""
    n = df.select(syntax_check(F.coalesce(code, F.lit(""))).alias("s")).agg(F.count_if("s.valid").alias("valid"), F.count(F.lit(1)).alias("total"))
    whole = F.lit(sample_count) if sample_count else F.col("total")
    return n.select("valid", whole.cast("long").alias("total"), F.bround(F.try_divide(F.col("valid") * 100.0, whole.cast("double")), 2).alias("apr"))
