"""Template filling with columns: ``fill("HR={v} bpm", v=col)`` -> ``concat``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{(\w+)\}")


def fill(template: str, **cols: Column) -> Column:
    """Concatenate the literal pieces of ``template`` with the named columns.

    Like ``concat``, the result is null when any filled column is null; wrap
    optional parts in ``coalesce`` before passing them.
    """
    parts: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def bool_text(col: Column) -> Column:
    """Booleans as ``True``/``False`` text (the mirrored output prints Python booleans)."""
    return F.when(col, F.lit("True")).when(~col, F.lit("False")).otherwise(F.lit("None"))
