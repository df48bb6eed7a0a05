"""Writers (K1-K9, K11). Tables are written by Spark; pages and small tables for people are rendered on the driver from bounded frames."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from . import ledger

ROWS_SHOWN = 1000


def append_runs(runs: DataFrame, folder: str, *order: Column | str, batch: str = "", copies: bool = True) -> None:
    """K1: rows added to the log of runs in one commit, and a copy in each run's folder; a batch that was added before adds nothing."""
    ledger.append(runs, folder, "result", order, batch, copies)


def write_predictions(predictions: DataFrame, folder: str, *order: Column | str) -> None:
    """K2: one folder per run, replaced; other runs stay. Lines are numbered by `order`, or as the rows come."""
    numbered = (predictions.orderBy(*order) if order else predictions).withColumn("line", F.monotonically_increasing_id())
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("exp_id").json(folder)


def save_states(states: DataFrame, folder: str, batch: str = "") -> None:
    """K4: a status file per run, all of them or none; each run's last one counts."""
    ledger.append(states, folder, "status", (), batch)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, replaced."""
    df.write.mode("overwrite").json(path)


def upsert_states(current: DataFrame, changed: DataFrame, folder: str) -> None:
    """K4: a new snapshot of keyed states: the changed ones replace those of the same run. The snapshot is complete before `current` gives way."""
    current.join(changed.select("exp_id"), "exp_id", "left_anti").unionByName(changed).write.mode("overwrite").json(folder)


def ordered_columns(df: DataFrame, lead: tuple[str, ...] = ("dataset", "arm", "model", "variant")) -> DataFrame:
    """K5: leading columns, then the rest by name."""
    return df.select(*[c for c in lead if c in df.columns], *sorted(c for c in df.columns if c not in lead))


def write_csv(df: DataFrame, path: str) -> None:
    """K5: a CSV table with header; result tables are small, so it is one file."""
    ordered_columns(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _cells(df: DataFrame, heads: list[str]) -> list[Column]:
    """Values as people read them: numbers with fractions to three decimals, nothing for null; a value with _lo and _hi columns is shown with its interval."""
    kinds = dict(df.dtypes)
    shown = lambda c: F.coalesce(N.fixed(F.col(f"`{c}`"), 3) if kinds[c] in ("double", "float") else F.col(f"`{c}`").cast("string"), F.lit(""))

    def value(c: str) -> Column:
        lo, hi = f"{c}_lo", f"{c}_hi"
        if lo not in kinds or hi not in kinds:
            return shown(c)
        known = F.col(f"`{lo}`").isNotNull() & F.col(f"`{hi}`").isNotNull()
        return F.concat(shown(c), F.when(known, F.concat(F.lit(" ["), shown(lo), F.lit(", "), shown(hi), F.lit("]"))).otherwise(""))

    return [value(c) for c in heads]


def _numbered(df: DataFrame, by: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """The first `limit` rows of each group, by place; without groups and order, the first rows as they are."""
    if order:
        return df.withColumn("_at", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))).where(F.col("_at") <= limit)
    return df.limit(limit).withColumn("_at", F.monotonically_increasing_id())


def _text(rows: DataFrame, by: list[str], line: Column, first: str, last: str, between: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_at", line.alias("x")))), lambda r: r["x"])
    return rows.groupBy(*by).agg(F.concat(F.lit(first), F.array_join(lines, between), F.lit(last)).alias("text"))


def markdown_tables(df: DataFrame, by: list[str] = (), order: list[Column | str] = (), limit: int = ROWS_SHOWN) -> DataFrame:
    """By, text: a Markdown table of each group's first `limit` rows (what people are shown); pipes become slashes."""
    by, plain = list(by), lambda x: F.translate(x, "|", "/")
    heads = [c for c in df.columns if not c.endswith(("_lo", "_hi")) and c not in by]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(plain(c) for c in _cells(df, heads))), F.lit(" |"))
    top = "| " + " | ".join(h.replace("|", "/") for h in heads) + " |\n|" + "---|" * len(heads)
    made = _text(_numbered(df, by, list(order), limit), by, F.concat(F.lit("\n"), line), top, "", "")
    return made


def html_tables(df: DataFrame, by: list[str] = (), order: list[Column | str] = (), limit: int = ROWS_SHOWN) -> DataFrame:
    """By, text: an HTML table of each group's first `limit` rows, escaped."""
    by = list(by)
    heads = [c for c in df.columns if c not in by]

    def escaped(x: Column) -> Column:
        for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            x = F.replace(x, F.lit(c), F.lit(e))
        return F.concat(F.lit("<td>"), x, F.lit("</td>"))

    kinds = dict(df.dtypes)
    cells = [F.coalesce(N.fixed(F.col(f"`{c}`"), 3) if kinds[c] in ("double", "float") else F.col(f"`{c}`").cast("string"), F.lit("")) for c in heads]
    top = "<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in heads) + "</tr>"
    return _text(_numbered(df, by, list(order), limit), by, F.concat(F.lit("<tr>"), *(escaped(c) for c in cells), F.lit("</tr>")), top, "</table>", "")


def markdown_table(df: DataFrame, limit: int = ROWS_SHOWN) -> str:
    """At most `limit` rows as Markdown, for a page that the driver writes."""
    return markdown_tables(df, limit=limit).first().text


def html_table(df: DataFrame, limit: int = ROWS_SHOWN) -> str:
    """At most `limit` rows as HTML, for a page that the driver writes."""
    return html_tables(df, limit=limit).first().text


def write_md(tables: DataFrame, folder: str, *by: str) -> None:
    """K6: texts of tables as files, in a folder for each group."""
    (tables.write.partitionBy(*by) if by else tables.coalesce(1).write).mode("overwrite").option("lineSep", "\n").text(folder)


def report(title: str, sections: dict[str, DataFrame]) -> tuple[str, str]:
    """The page and the Markdown text of a report: a table per section; empty frames are left out."""
    kept = {k: d for k, d in sections.items() if not d.isEmpty()}
    page = "".join(f"<h2>{html.escape(k)}</h2>{html_table(d)}" for k, d in kept.items())
    text = "\n\n".join(f"## {k}\n\n{markdown_table(d)}" for k, d in kept.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{page}</body></html>", f"# {title}\n\n{text}\n"


def manifest_rows(items: DataFrame) -> DataFrame:
    """Dataset, split, n, n_verified: what a manifest counts."""
    return items.groupBy("dataset", "split").agg(F.count("*").alias("n"), F.count("gold_program").alias("n_verified"))


def manifest(items: DataFrame, version: str, commit: str) -> str:
    """Counts per data set and split, as JSON; data sets and their splits are a handful."""
    splits: dict = {}
    for r in manifest_rows(items).orderBy("dataset", "split").collect():
        splits.setdefault(r.dataset, {})[r.split] = {"n": r.n, "n_verified": r.n_verified}
    return json.dumps({"preprocess_version": version, "code_commit": commit, "datasets": splits}, indent=2, sort_keys=True)


def dataset_card(items: DataFrame, title: str, version: str, commit: str) -> str:
    """The manifest's counts for people, in Markdown."""
    counts = items.groupBy("dataset", "split").agg(F.count("*").alias("questions"), F.count("gold_program").alias("verified programs")).orderBy("dataset", "split")
    return f"# {title}\n\nPrepared with version {version}, code {commit}.\n\n{markdown_table(counts)}\n"


def packable(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that go into a result archive: no weights or archives, nothing in a folder of checkpoints. Paths are relative to the folder of runs."""
    p = F.col(path)
    return files.where(~p.rlike(r"[^/]\.(safetensors|bin|pt|pth|ckpt|zip)$") & ~p.rlike(r"(^|/)(checkpoints(/|$)|checkpoint-)"))
