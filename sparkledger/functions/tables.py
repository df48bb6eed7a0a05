"""Tables and prompts as text (N19, T1-T6). A table is array<array<string>>; its first row is the header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import format_answer, of
from .text import squeeze, strip

# Texts that are part of the model's input.
SYSTEM_PROMPT = "You are a financial analyst. Answer the question using only the report excerpt provided (its text and table)."
INSTRUCTIONS = {
    ("answer", "default"): "Give only the final answer: a number (write ratios and percentages as decimals, e.g. 0.145 for 14.5%) or yes/no.",
    ("answer", "tatqa"): "Give only the final answer: a number in the report's units (percentages as percent values, e.g. 14.5), a text span, or several spans separated by '; '.",
    ("pot", "default"): 'Write a Python program that computes the answer from the numbers in the report and assigns it to a variable named `answer` (ratios and percentages as decimals; "yes"/"no" for comparisons). Reply with only the program in a ```python code block.',
    ("pot", "tatqa"): "Write a Python program that computes the answer from the numbers in the report and assigns it to a variable named `answer`, in the report's units (percentages as percent values). Reply with only the program in a ```python code block.",
}


def normalize_numbers(x: Column) -> Column:
    """Thousands separators removed, nothing else."""
    return F.regexp_replace(x, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")


def clean_cell(x: Column) -> Column:
    """Single spaces, pipes escaped; null is empty."""
    return F.replace(squeeze(F.coalesce(x, F.lit(""))), F.lit("|"), F.lit("\\|"))


def normalize_table(table: Column) -> Column:
    """Thousands separators removed in every cell."""
    return F.transform(table, lambda row: F.transform(row, normalize_numbers))


def linearize_table(table: Column) -> Column:
    """The table in Markdown, short rows padded; '' for an empty table."""
    rows = F.transform(F.filter(table, lambda r: r.isNotNull()), lambda r: F.transform(r, clean_cell))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.array(F.concat(F.lit("|"), F.repeat(F.lit("---|"), width)))
    markdown = F.array_join(F.concat(F.slice(lines, F.lit(1), F.lit(1)), rule, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, F.lit("")).otherwise(markdown)


def paragraphs(*parts: Column) -> Column:
    """The parts that aren't empty, with a blank line between them."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")


def build_context(pre: Column, table: Column, post: Column) -> Column:
    """T4: text before, table and text after. pre and post: array<string>."""
    say = lambda x: strip(normalize_numbers(F.array_join(F.coalesce(x, F.array().cast("array<string>")), " ")))
    return paragraphs(say(pre), linearize_table(normalize_table(table)), say(post))


def task_block(context: Column, question: Column, history: Column | None = None) -> Column:
    """The report, the conversation so far and the question. history: array<struct<question, answer struct>>."""
    talk = F.lit("")
    if history is not None:
        turns = F.array_join(F.transform(history, lambda h: F.concat(F.lit("Q: "), h["question"], F.lit("\nA: "), format_answer(of(h["answer"])))), "\n")
        talk = F.when(F.coalesce(F.size(history), F.lit(0)) > 0, F.concat(F.lit("Conversation so far:\n"), turns, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("Report:\n"), context, F.lit("\n\n"), talk, F.lit("Question: "), question)


def build_prompt(block: Column, style: str, dataset: Column, shots: Column | None = None) -> Column:
    """T5: the user message. shots: array<struct<block, target>> of worked examples."""
    if style not in ("answer", "pot"):
        raise NotImplementedError(f"there is no prompt for style {style!r}")
    task = F.when(dataset == "tatqa", F.lit(INSTRUCTIONS[style, "tatqa"])).otherwise(F.lit(INSTRUCTIONS[style, "default"]))
    body = F.concat(block, F.lit("\n\n"), task)
    if shots is None:
        return body
    worked = F.transform(shots, lambda s, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\n\n"), s["block"], F.lit("\n\nAnswer:\n"), s["target"]))
    return F.when(F.size(worked) > 0, F.concat(F.array_join(worked, "\n\n"), F.lit("\n\nNow answer this one.\n\n"), body)).otherwise(body)


def build_messages(prompt: Column) -> Column:
    """T5: chat messages, as array<struct<role, content>>."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", F.lit(SYSTEM_PROMPT)), say("user", prompt))


def format_target(answer: Column, program: Column, supervision: str) -> Column:
    """What a model is trained to reply. A missing program is an error, as are kinds without a format."""
    if supervision == "answer":
        return format_answer(of(answer))
    if supervision == "pot_gold":
        missing = F.raise_error(F.lit("an item has no verified gold program"))
        return F.when(F.coalesce(program, F.lit("")) == "", missing.cast("string")).otherwise(F.concat(F.lit("```python\n"), program, F.lit("\n```")))
    if supervision == "cot":
        raise NotImplementedError("rationales have no format yet")
    raise ValueError(f"no target format for supervision {supervision!r}")
