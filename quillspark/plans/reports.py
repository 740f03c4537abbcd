"""Markdown reports from small metric tables; numbers come from the tables, findings are not canned."""

from __future__ import annotations

from pyspark.sql import DataFrame


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A table of up to ``most`` rows; reports are for aggregates. A last line tells of rows left out."""
    rows = df.limit(most + 1).collect()
    more = [f"\nOnly the first {most} rows are shown."] if len(rows) > most else []
    rows = rows[:most]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |" for row in rows] + more)


def report(title: str, sections: dict[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())]) + "\n"
