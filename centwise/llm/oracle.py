"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from centwise.llm import lines, mixing, negatives, warc

ORACLE: dict[str, str] = {
    "op4_line_dedup": lines.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op12_negatives": negatives.ORACLE_SQL,
    "op13_mixing": mixing.ORACLE_SQL,
}
