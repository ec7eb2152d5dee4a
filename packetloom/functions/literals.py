"""Small constant tables inside expressions.

Written as SQL text: one call builds the whole constant, and it folds into a
literal, so no join and nothing to ship.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def literal_map(table: dict) -> Column:
    return F.expr(f"map({', '.join(_text(x) for pair in table.items() for x in pair)})")


def literal_array(values: list) -> Column:
    return F.expr(f"array({', '.join(map(_text, values))})")
