"""A plan kept in Markdown, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the document format, and phases that may overlap others.
HEADING, DASH, NOTE = "### ", " — ", "  *("
BOX, MARKS, BOLD = "- [", {"x": "done", "~": "doing", " ": "open"}, "**"
PRIORITIES = ["M", "S", "C"]
PARALLEL = {"P2": ["P1", "P3", "P4", "P5"]}


def _phase_id(x: Column) -> Column:
    """x if it is a P and digits, else null."""
    return F.when(F.startswith(x, F.lit("P")) & F.substring(x, 2, 99).try_cast("int").isNotNull() & (F.translate(x, "0123456789", "") == "P"), x)


def heading(line: Column) -> Column:
    """A phase's heading as struct<phase, name>, both null for any other line: '### P2 — name  *(note)*'."""
    phase = F.when(F.startswith(line, F.lit(HEADING)) & F.contains(line, F.lit(DASH)), _phase_id(F.substring(F.substring_index(line, DASH, 1), len(HEADING) + 1, 99)))
    rest = F.rtrim(F.substr(line, F.locate(DASH, line) + len(DASH)))
    name = F.trim(F.when(F.endswith(rest, F.lit(")*")), F.substring_index(rest, NOTE, 1)).otherwise(rest))
    return F.struct(phase.alias("phase"), F.when(phase.isNotNull(), name).alias("name"))


def task(line: Column) -> Column:
    """A task's line as struct<task, status, priority, bold, rest>, task null for any other line: '- [x] **P1.2 (M) title** rest'."""
    mark = F.try_element_at(F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair)), F.substring(line, len(BOX) + 1, 1))
    body = F.substr(line, F.lit(len(BOX) + 6))  # after the mark, '] ' and '**'
    bold = F.substring_index(body, BOLD, 1)
    word = F.substring_index(F.substring_index(bold, " ", 1), ":", 1)
    number = F.split(word, r"\.")
    known = F.startswith(line, F.lit(BOX)) & mark.isNotNull() & (F.substring(line, len(BOX) + 2, 4) == "] **") & F.contains(body, F.lit(BOLD))
    task = F.when(known & _phase_id(F.get(number, F.lit(0))).isNotNull() & (F.regexp_count(F.coalesce(F.get(number, F.lit(1)), F.lit("")), F.lit("^[0-9]")) == 1), F.concat(F.get(number, F.lit(0)), F.lit("."), F.regexp_substr(F.get(number, F.lit(1)), F.lit("^[0-9]+"))))
    tail = F.substr(bold, F.length(task) + 1)
    priority = F.when((F.substring(tail, 1, 2) == " (") & (F.substring(tail, 4, 1) == ")") & F.substring(tail, 3, 1).isin(PRIORITIES), F.substring(tail, 3, 1))
    return F.struct(task.alias("task"), mark.alias("status"), priority.alias("priority"), F.when(priority.isNotNull(), F.substring(tail, 5, 10_000)).otherwise(tail).alias("bold"), F.substr(body, F.locate(BOLD, body) + len(BOLD)).alias("rest"))


def glance(line: Column) -> Column:
    """A row of the overview as struct<phase, hours>, phase null for any other line: '| **P1** name | ... | hours | ...'."""
    cells = F.split(line, r"\|")
    first = F.trim(F.get(cells, F.lit(1)))
    phase = F.when(F.startswith(line, F.lit("| **")) & (F.size(cells) >= 5), _phase_id(F.substring_index(F.substring(first, 3, 10_000), BOLD, 1)))
    return F.struct(phase.alias("phase"), F.lower(F.trim(F.get(cells, F.lit(3)))).alias("hours"))


def lines(docs: DataFrame, text: str = "text", by: str = "doc") -> DataFrame:
    """A row per line, with the phase and the `##` section it stands under. A document is one row, so its lines are one group."""
    each = docs.select(by, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    above = Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    phase = heading(F.col("line"))["phase"]
    section = F.when(F.startswith("line", F.lit("## ")), F.lower("line"))
    return each.withColumns({"phase": F.last(phase, True).over(above), "section": F.last(section, True).over(above)})


def title(bold: Column, rest: Column) -> Column:
    """The first sentence of the bold text, or of what follows it; at most 90 characters. A sentence ends at a full stop or semicolon before a space."""
    raw = F.trim(F.replace(F.coalesce(F.nullif(F.trim(bold), F.lit("")), rest), F.lit(BOLD), F.lit("")))
    spaced = F.concat(raw, F.lit(" "))
    ends = F.filter(F.array(F.locate(". ", spaced), F.locate("; ", spaced)), lambda k: k > 0)
    sentence = F.rtrim(F.coalesce(F.substr(raw, F.lit(1), F.array_min(ends)), raw), F.lit(".;"))
    return F.when(F.length(sentence) > 90, F.concat(F.left(sentence, F.lit(87)), F.lit("..."))).otherwise(sentence)


def tasks(each: DataFrame, by: str = "doc") -> DataFrame:
    """Tasks with status, priority (null if none) and title."""
    found = each.where("phase is not null").withColumn("_task", task(F.col("line"))).where("_task.task is not null")
    return found.select(by, "n", "phase", "_task.task", "_task.status", "_task.priority", title(F.col("_task.bold"), F.col("_task.rest")).alias("title"))


def phases(each: DataFrame, by: str = "doc") -> DataFrame:
    """Phases with tasks done and in all, whether complete, and the GPU hours they are estimated at (null: not part of the budget)."""
    heads = each.withColumn("_head", heading(F.col("line"))).where("_head.phase is not null").select(by, "phase", F.col("n").alias("ord"), "_head.name")
    done = tasks(each, by).groupBy(by, "phase").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"))
    over = each.withColumn("_row", glance(F.col("line"))).where("_row.phase is not null").groupBy(by, F.col("_row.phase").alias("phase")).agg(F.max_by("_row.hours", "n").alias("e"))
    hours = F.when(~F.contains("e", F.lit("used")) & ~F.contains("e", F.lit("rented")), F.regexp_extract("e", r"(\d+(?:\.\d+)?)", 1).try_cast("double"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return heads.join(done, [by, "phase"], "left").join(over, [by, "phase"], "left").select(by, "phase", "ord", "name", n("total").alias("total"), n("done").alias("done"), ((n("total") > 0) & (n("total") == n("done"))).alias("complete"), hours.alias("gpu_hours"))


def used_hours(each: DataFrame, by: str = "doc") -> DataFrame:
    """Hours of the run log: the last cell of its dated rows."""
    cells = F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|")
    rows = each.where(F.startswith("section", F.lit("## 8. run log")) & F.startswith("line", F.lit("| 20")))
    return rows.groupBy(by).agg(F.coalesce(F.sum(F.trim(F.element_at(cells, -1)).try_cast("double")), F.lit(0.0)).alias("used_hours"))


def next_tasks(found: DataFrame, n: int = 3, by: str = "doc") -> DataFrame:
    """The first n tasks of each phase that aren't done."""
    rank = F.row_number().over(Window.partitionBy(by, "phase").orderBy("n"))
    return found.where("status <> 'done'").withColumn("rank", rank).where(F.col("rank") <= n)


def parallel_phases(found: DataFrame, by: str = "doc") -> DataFrame:
    """Open phases that may run beside the current one, the first that isn't complete."""
    now = found.where("not complete").groupBy(by).agg(F.min_by("phase", "ord").alias("current"))
    beside = F.try_element_at(F.create_map(*(x for k, v in PARALLEL.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("phase"))
    return found.where("not complete").join(now, by).where((F.col("phase") != F.col("current")) & F.array_contains(beside, F.col("current"))).select(by, "phase", "current")
