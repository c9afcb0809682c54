"""Prompt assembly as column expressions. Wording and shots are parameters; the functions fix the structure alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE = "array<struct<role string, content string>>"


def fill(template: str, **values: Column) -> Column:
    """A template with {name} places; braces that name no value stay."""
    parts, rest = [], template
    while rest:
        at = min(((i, n) for n in values if (i := rest.find("{" + n + "}")) >= 0), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        i, name = at
        parts += [F.lit(rest[:i]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[i + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def with_shot(template: str, shots: dict[str, str], lang: Column, **values: Column) -> Column:
    """A template whose {shot} is the language's one, or nothing."""
    shot = F.lit("")
    for name, text in shots.items():
        shot = F.when(lang == name, text).otherwise(shot)
    return fill(template, shot=shot, lang=lang, **values)


@dataclass
class Layout:
    """The texts of block prompts."""

    # Heads, marks and tags.

    rule: str = "# ==================================================\n"
    code_head: str = "# [USER INPUT CODE]\n"
    trace_head: str = "# [KEY LOGIC TRACE]\n"
    trace_mark: str = "# > "
    ask: str = "Summarize this code in one to three sentences.\n"
    open_tag: str = "<SUMMARY>\n"
    close_tag: str = "\n</SUMMARY>"
    system: str = "You summarize code."
    rules: list[str] = field(default_factory=lambda: ["Read the code.", "The trace hints at what matters.", "Answer between the tags."])


def annotated(code: Column, trace: Column, layout: Layout, use_trace: bool = True) -> Column:
    """The question for one code: its text, the trace's lines that aren't blank if wanted, and the instruction."""
    lines = F.transform(F.filter(F.coalesce(trace, F.array().cast("array<string>")), lambda s: F.coalesce(F.btrim(s), F.lit("")) != ""), lambda s: F.concat(F.lit(layout.trace_mark), F.btrim(s)))
    text = [F.lit(layout.rule + layout.code_head), F.btrim(code), F.lit("\n\n")]
    if use_trace:
        text += [F.lit(layout.trace_head), F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("\n")]
    return F.concat(*text, F.lit(layout.ask))


def answered(summary: Column, layout: Layout) -> Column:
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit(layout.open_tag), F.btrim(summary), F.lit(layout.close_tag))).otherwise("")


def completion_prompt(code: Column, trace: Column, shots: Column, layout: Layout, use_trace: bool = True, use_shots: bool = True, most_shots: int = 3) -> Column:
    """Guidelines, examples (array of struct(code, trace, summary)), the target and an open answer."""
    rules = layout.rules if use_trace else [layout.rules[0], *layout.rules[2:]]
    head = layout.system + "\n\nGUIDELINES:\n" + "".join(f"{i}. {r}\n" for i, r in enumerate(rules, 1)) + "\nExamples:\n\n"
    white = F.lit(" \t\n\r")
    example = lambda s: F.concat(F.btrim(annotated(s["code"], s["trace"], layout, use_trace), white), F.lit("\n"), F.btrim(answered(s["summary"], layout), white), F.lit("\n\n"))
    given = F.array_join(F.transform(F.slice(shots, 1, most_shots), example), "") if use_shots else F.lit("")
    return F.concat(F.lit(head), F.coalesce(given, F.lit("")), F.btrim(annotated(code, trace, layout, use_trace), white), F.lit("\n" + layout.open_tag))


def chat_messages(system: Column, shots: Column, question: Column) -> Column:
    """System, then user and assistant for each shot (struct(question, answer)), then the user's question."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = F.flatten(F.transform(F.coalesce(shots, F.array().cast("array<struct<question string, answer string>>")), lambda s: F.array(message("user", s["question"]), message("assistant", s["answer"]))))
    return F.concat(F.array(message("system", system)), turns, F.array(message("user", question))).cast(MESSAGE)


def variant_tag(sentences: Column, dynamic: Column, few: Column) -> Column:
    """G8."""
    bit = lambda c: c.cast("int").cast("string")
    return (
        F.when(sentences & dynamic & few, "full")
        .when(~sentences & dynamic & few, "woKey")
        .when(sentences & ~dynamic & few, "woRet")
        .when(~sentences & ~dynamic & ~few, "woMod")
        .otherwise(F.concat(F.lit("sent"), bit(sentences), F.lit("_dyn"), bit(dynamic), F.lit("_few"), bit(few)))
    )
