"""Text sink for export lines."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the ``line`` column in canonical order.

    ``orderBy`` is a range-partitioned sort: the part files in name order are the whole
    text, and no task sees more than its own range.
    """
    lines.orderBy("row_idx").select("line").write.mode(mode).text(path)
