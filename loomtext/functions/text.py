"""Scalar text functions as Catalyst expressions.

`\\w` is written [\\p{L}\\p{N}_] so that JVM and SQL oracle agree on non-ASCII text; `(?U)` makes `\\s` Unicode white space and `(?d)`
keeps `.`, `^` and `$` to line feeds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
#: White space that trimming removes.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# The markers that end a summary, in the order in which they cut (case-insensitive).
CUTOFFS = [
    "Args:", "Arguments:", "Parameters", "----------", "Returns:", "Returns", "Yields:", "Raises:",
    ":param", ":return", ":rtype", ":raise", r"\.\. code::", r"\.\. math::",
    "@param", "@return", "@arg", "@field", "@brief", "@see", "@usage",
    "Examples:", "Example:", ">>>", r"E\.g\.", r"e\.g\.", r"i\.e\.", "###", "===",
]
# Words that carry no content.
STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "for", "on", "with", "as", "by"]
# By language, what a documentation comment is; the lines of the second kind stand right above what follows.
DOC_COMMENTS = {"julia": [r'(?s)^"""(.*?)"""', r'(?s)^"(.*?)"'], "ocaml": [r"(?s)\(\*\*(.*?)\*\)"]}
DOC_LINES = {
    "lua": ("--", r"\s*(?:local\s+)?function"),
    "r": ("#", rf"\s*[\p{{L}}\p{{N}}_.]+\s*(?:<-|=)\s*function"),
    "racket": (";;", r"\s*\(define"),
}
# By language, where a function's name stands.
FUNCTION_NAMES = {
    "julia": rf"function\s+({WORD}+)",
    "lua": rf"function\s+({WORD}+)",
    "r": rf"({WORD}+)\s*(?:<-|=)\s*function",
    "racket": rf"\(define\s+\(({WORD}+)",
    "ocaml": rf"let\s+({WORD}+)",
}
# The published NIST normalisation: entities, then patterns that set punctuation apart (all ASCII punctuation but
# the apostrophe, comma, hyphen and period; then periods and commas not within numbers; then dashes after digits).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]
NIST_PATTERNS = [(r"([{-~\[-` -&(-+:-@/])", " $1 "), ("([^0-9])([.,])", "$1 $2 "), ("([.,])([^0-9])", " $1 $2"), ("([0-9])(-)", "$1 $2 ")]
# Remarks that end an answer's code, forward and backward.
REMARKS = {True: ["\nNote:", "\nExplanation:", "The Python code"], False: ["\nNote:", "\nExplanation:", "The code:"]}
# Characters that open a comment line, by language, stripped one set after the other.
MARKERS = {"lua": ["-"], "r": ["#", "'"], "julia": ["#", "'"], "racket": [";"], "ocaml": ["*"]}


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


def words(x: Column) -> Column:
    """Non-space runs; none for blank text."""
    return F.filter(F.split(x, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once, also where a lambda uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_sentence(x: Column) -> Column:
    """The first sentence of the joined non-blank lines, or else the first such line; null for blank text."""
    lines = F.filter(F.split(trim(x), LINE_ENDS), lambda line: trim(line) != "")
    # a match anywhere would be one from the start
    sentence = lambda ls: trim(F.regexp_extract(F.array_join(ls, " "), r"(?Ud)^(.+?[.!?])(\s|$)", 1))
    chosen = lambda ls: bind(sentence(ls), lambda s: F.when(s != "", s).otherwise(trim(F.get(ls, F.lit(0)))))
    return bind(lines, chosen)


def _longest(matches: Column) -> Column:
    """The first of the longest."""
    return F.aggregate(matches, F.lit(None).cast("string"), lambda a, m: F.when(a.isNull() | (F.length(m) > F.length(a)), m).otherwise(a))


def raw_comment(code: Column, lang: Column) -> Column:
    """The documentation comment that belongs to the function, markers included."""
    code = trim(code)
    whole = lambda p: F.when(code.rlike(p), F.regexp_extract(code, p, 1))
    lines = lambda start, before: _longest(F.regexp_extract_all(code, F.lit(rf"(?dm)((?:^\s*{start}.*$\n?)+)(?={before})"), F.lit(1)))
    found = [F.when(lang == name, F.coalesce(*map(whole, patterns))) for name, patterns in DOC_COMMENTS.items()]
    found += [F.when(lang == name, lines(*parts)) for name, parts in DOC_LINES.items()]
    return F.when(code != "", F.coalesce(*found))


def code_only(content: Column, lang: Column) -> Column:
    """The code without comments and blank lines; null for blank content."""
    body = trim(content)
    gone = lambda x, pattern: F.regexp_replace(x, pattern, "")
    bare = body
    for name, patterns in DOC_COMMENTS.items():
        own = body
        for pattern in patterns:
            own = gone(own, pattern)
        bare = F.when(lang == name, own).otherwise(bare)
    for name, (start, _) in DOC_LINES.items():  # wherever they stand
        bare = F.when(lang == name, gone(body, rf"(?dm)^\s*{start}.*$")).otherwise(bare)
    return F.when(body != "", F.array_join(F.filter(F.split(bare, "\n"), lambda line: trim(line) != ""), "\n"))


def strip_markers(x: Column, lang: Column) -> Column:
    """T4: lines trimmed, their leading comment characters gone, empty ones dropped."""

    def bare(line: Column) -> Column:
        out = trim(line)
        cases = None
        for name, sets in MARKERS.items():
            own = out
            for chars in sets:
                own = F.ltrim(own, F.lit(chars))
            cases = F.when(lang == name, trim(own)) if cases is None else cases.when(lang == name, trim(own))
        return cases.otherwise(out)

    return F.array_join(F.filter(F.transform(F.split(x, "\n"), bare), lambda line: line != ""), "\n")


def cut_off(x: Column) -> Column:
    """Cut at the first match of each marker in turn; a marker that an earlier cut has halved no longer counts."""
    cut = x
    for pattern in CUTOFFS:
        cut = F.split(cut, f"(?i){pattern}", 2)[0]
    # most texts have none of them, which plain searches tell at once
    low = lambda y: reduce(lambda a, b: a | b, [F.contains(y, F.lit(p.replace("\\", "").lower())) for p in CUTOFFS])
    return F.when(bind(F.lower(x), low), cut).otherwise(x)


def clean_summary(x: Column, lang: Column) -> Column:
    """T5: a summary of 3 to 50 words, or null."""
    tidy = lambda bare: squeeze(F.regexp_replace(F.regexp_replace(cut_off(bare), r"(?d):[a-z]+ .*?:", ""), "\r", ""))
    whole = lambda text: F.size(words(text)).between(3, 50) & (F.length(text) >= 10) & ~text.contains("TODO") & ~text.contains("FIXME")
    usable = lambda bare: (bare != "") & ~bare.rlike("^(:type|:rtype|>>>)")
    summary = lambda bare: F.when(usable(bare), bind(tidy(bare), lambda text: F.when(whole(text), text)))
    return bind(strip_markers(x, lang), summary)


def alnum(x: Column) -> Column:
    """Lower-case ASCII letters and digits alone; null counts as empty."""
    return F.coalesce(F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), F.lit(""))


def word_tokens(x: Column) -> Column:
    """Runs of word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(x), F.lit(f"({WORD}+)"), F.lit(1))


def identifiers(x: Column) -> Column:
    """Words of word characters that begin with an ASCII letter or underscore, lower-cased."""
    return F.regexp_extract_all(F.lower(x), F.lit(rf"(?<!{WORD})([a-z_]{WORD}*)"), F.lit(1))


def token_overlap(summary: Column, code: Column) -> Column:
    """Distinct summary identifiers found in the code, over the number of summary identifiers that aren't stop words."""
    kept = F.filter(identifiers(summary), lambda w: ~w.isin(STOPWORDS))
    return F.when(F.size(kept) == 0, 0.0).otherwise(F.size(F.array_intersect(identifiers(code), kept)) / F.size(kept))


def parameters(code: Column) -> Column:
    """The comma-separated parts of the first parenthesis group that isn't empty."""
    return F.split(F.regexp_extract(code, r"\(([^)]+)\)", 1), ",")


def has_blank_parameter(code: Column) -> Column:
    return code.rlike(r"\([^)]+\)") & F.exists(parameters(code), lambda p: trim(p) == "")


def identifier_ratio(summary: Column, code: Column, lang: Column) -> Column:
    """The share of summary words that name the function or a parameter; null without words."""
    name = F.coalesce(*(F.when(lang == k, F.regexp_extract(code, p, 1)) for k, p in FUNCTION_NAMES.items()), F.lit(""))
    first = F.transform(parameters(code), lambda p: F.get(F.split(squeeze(p), " "), F.lit(0)))
    names = F.filter(F.transform(F.concat(F.array(name), first), F.lower), lambda w: w.rlike(rf"^[\p{{L}}_]{WORD}*$"))
    share = lambda b: F.when(F.size(b["found"]) > 0, F.size(F.filter(b["found"], lambda w: F.array_contains(b["names"], w))) / F.size(b["found"]))
    return bind(F.struct(names.alias("names"), word_tokens(summary).alias("found")), share)


def fold_comments(code: Column) -> tuple[Column, Column]:
    """(comment, code): the texts of lines that begin with #, and the other lines, each joined by a space; null if none."""
    lines = F.split(code, "\n")
    is_comment = lambda line: F.ltrim(line, F.lit(WHITE)).startswith("#")
    joined = lambda x: F.when(F.size(x) > 0, F.array_join(x, " "))
    texts = F.transform(F.filter(lines, is_comment), lambda line: trim(F.ltrim(trim(line), F.lit("#"))))
    return joined(texts), joined(F.filter(lines, lambda line: ~is_comment(line)))


def strip_docstrings(code: Column, docstring: Column) -> Column:
    """Triple-quoted strings that begin a line go, then the given docstring's own text."""
    code = F.regexp_replace(code, r'(?dm)^\s*"""[\s\S]*?"""', "")
    code = F.regexp_replace(code, r"(?dm)^\s*'''[\s\S]*?'''", "")
    return F.coalesce(trim(F.when(F.coalesce(docstring, F.lit("")) != "", F.replace(code, docstring, F.lit(""))).otherwise(code)), F.lit(""))


def join_tokens(tokens: Column, close_periods: bool = True, docstring: Column | None = None) -> Column:
    """Tokens joined by a space, of the docstring's words if there are none; close_periods also closes up ` .`."""
    if docstring is not None:
        tokens = F.when(F.coalesce(F.size(tokens), F.lit(0)) > 0, tokens).otherwise(words(F.coalesce(docstring, F.lit(""))))
    text = F.array_join(tokens, " ")
    return trim(F.replace(text, F.lit(" ."), F.lit(".")) if close_periods else text)


def _fenced(text: Column, language: str) -> Column:
    pattern = rf"(?is)```{language}\s*(.*?)\s*```"
    return F.when(text.rlike(pattern), trim(F.regexp_extract(text, pattern, 1)))


def extract_code(text: Column, forward: bool = True) -> Column:
    """Code from a generated answer: the tagged part (and a fence in it), else a fence, else the text up to a remark."""
    tag, within, fence = ("PYTHON", "(?:python)?", "python") if forward else ("CODE", rf"(?:{WORD}+)?", rf"(?:{WORD}+)?")
    pattern = f"(?is)<{tag}>(.*?)</{tag}>"
    inner = trim(F.regexp_extract(text, pattern, 1))
    bare = text
    for mark in REMARKS[forward]:
        bare = F.split(bare, f"(?i){mark}", 2)[0]
    return F.when(text.rlike(pattern), F.coalesce(_fenced(inner, within), inner)).otherwise(F.coalesce(_fenced(text, fence), trim(bare)))


def extract_code_permissive(text: Column) -> Column:
    """As extract_code, but fences may be unclosed, then code is guessed from keywords, then from lines that aren't remarks; never empty where text isn't."""
    text = trim(text)
    fence = F.nullif(trim(F.regexp_extract(text, rf"(?is)```(?:{WORD}+)?\s*(.*?)(?:```|\z)", 1)), F.lit(""))
    # What begins code outside a fence, in order of preference.
    starts = [rf"(?s)((?:def|class|function|let|define|local)\s+{WORD}+.*)", r"(?s)(library\s*\(.*)", r"(?s)(#include\s*<.*)", r"(?s)(import\s+.*)"]
    found = [F.nullif(trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in starts]
    # What begins a line that is a remark.
    remarks = ["code:", "python code:", "ocaml code:", "here is", "julia code:", "//", "#", "note:"]
    remark = lambda line: F.lower(trim(line)).rlike("^(" + "|".join(remarks) + ")")
    lines = F.filter(F.split(text, "\n"), lambda line: (trim(line) != "") & ~remark(line))
    return F.coalesce(fence, *found, F.nullif(trim(F.array_join(lines, "\n")), F.lit("")), text)


def summary_tail(text: Column) -> Column:
    """What follows the last <SUMMARY>, without the end tag and leading #."""
    return F.ltrim(trim(F.replace(F.substring_index(text, "<SUMMARY>", -1), F.lit("</SUMMARY>"), F.lit(""))), F.lit("#"))


def punct_split(text: Column) -> Column:
    """Words and single symbols, joined by a space."""
    return F.array_join(F.regexp_extract_all(text, F.lit(rf"(?U)({WORD}+|[^\s\p{{L}}\p{{N}}_])"), F.lit(1)), " ")


def nist_tokens(text: Column, lower: bool = True) -> Column:
    """Lower-cased tokens (or as they are) with punctuation apart, except periods and commas within numbers."""
    x = F.replace(F.regexp_replace(F.replace(text, F.lit("<skipped>"), F.lit("")), "-\n", ""), F.lit("\n"), F.lit(" "))
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    x = F.lower(x) if lower else x
    for pattern, by in NIST_PATTERNS:
        x = F.regexp_replace(x, pattern, by)
    return words(x)


def block_text(x: Column) -> Column:
    """White space squeezed, lower-cased."""
    return F.lower(squeeze(x))


def model_tag(path: Column, full_names: bool = False) -> Column:
    """The folder tag of a model path, by the first name it contains; the last part of the path if none."""
    # Names and tags, in order of preference.
    tags = [("Llama", "Llama3th"), ("Seed", "Seed3th")]
    tags += [("deepseek-coder-6.7b-instruct", "ds_mid3th"), ("1.3b", "ds_small3th")] if full_names else [("1.3b", "ds_small3th"), ("6.7b", "ds_mid3th")]
    tags += [("Qwen", "qwen3th")]
    cases = F.when(path.contains(tags[0][0]), tags[0][1])
    for name, tag in tags[1:]:
        cases = cases.when(path.contains(name), tag)
    return cases.otherwise(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1))
