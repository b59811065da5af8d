"""Full case folding as a column, equal to Python's ``str.casefold``.

The table is made from that function over all code points: what folds to one character goes through one translation, and
only texts with a character that folds to several (sharp s, ligatures) are taken apart.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.spans import by_sql, let


@lru_cache(maxsize=1)
def tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other, what they fold to, and those that fold to several."""
    folds = {c: c.casefold() for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and c.casefold() != c}
    one = {c: f for c, f in folds.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in folds.items() if len(f) > 1}


def casefold(c: Column) -> Column:
    one, to, several = tables()
    pairs = ",".join(f"{k}:{v}" for k, v in several.items())
    apart = by_sql(F.translate(c, one, to), "s", f"array_join(transform(array(str_to_map('{pairs}')), m -> array_join(transform(split(s, ''), x -> coalesce(try_element_at(m, x), x)), '')), '')")
    ascii_only = F.regexp_like(c, F.lit("^\\p{ASCII}*$"))
    return let(c, lambda t: F.when(ascii_only, F.lower(c)).when(F.regexp_like(t, F.lit("[" + "".join(several) + "]")), apart).otherwise(F.translate(t, one, to)))
