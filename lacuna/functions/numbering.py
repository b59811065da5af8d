"""Numbering plans: which region a telephone number belongs to, by the longest prefix that any plan has.

A plan's entries are beginnings of numbers written with their calling code, the lengths of the national number behind that
code, and the region. Several regions may share a code: the entry with most digits decides, as in North America.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.spans import by_sql

# Calling code, trunk prefix of national numbers ("" where there is none; a "?" behind it where it may be left out), and
# (national beginnings, least and most digits of the national number) of each region.
PLANS = {
    "NZ": (64, "0", (("2", 8, 10), ("3 4 6 7 9", 7, 8), ("508 800 900", 8, 10))),
    "AU": (61, "0", (("2 3 4 7 8", 9, 9),)),
    "US": (1, "1?", (("2 3 4 5 6 7 8 9", 10, 10),)),
    "CA": (1, "1?", (("204 226 236 249 250 257 263 289 306 343 354 365 367 368 382 403 416 418 428 431 437 438 450 468 474 506 514 519 548 579 581 584 587 604 613 639 647 672 683 705 709 742 753 778 780 782 807 819 825 867 873 879 902 905", 10, 10),)),
    "GB": (44, "0", (("1 2 3", 9, 10), ("7", 10, 10), ("800 808", 9, 10))),
    "IE": (353, "0", (("1 2 4 5 6 7 9", 7, 9), ("8", 9, 9))),
    "AT": (43, "0", (("1 2 3 4 5 7", 7, 12), ("6", 10, 13))),
    "BE": (32, "0", (("1 2 3 5 6 7 8 9", 8, 8), ("4", 8, 9))),
    "BR": (55, "0?", (("1 2 3 4 5 6 7 8 9", 10, 11),)),
    "CH": (41, "0", (("2 3 4 5 6 7 8 9", 9, 9),)),
    "CN": (86, "0?", (("1", 11, 11), ("2 3 4 5 6 7 8 9", 9, 11))),
    "DE": (49, "0", (("2 3 4 5 6 7 8 9", 6, 11), ("15 16 17", 10, 11))),
    "DK": (45, "", (("2 3 4 5 6 7 8 9", 8, 8),)),
    "ES": (34, "", (("6 7 8 9", 9, 9),)),
    "FI": (358, "0", (("1 2 3 5 6 7 8 9", 6, 10), ("4 50", 7, 10))),
    "FJ": (679, "", (("2 3 4 5 6 7 8 9", 7, 7),)),
    "FR": (33, "0", (("1 2 3 4 5 6 7 8 9", 9, 9),)),
    "GR": (30, "", (("2 6 8", 10, 10),)),
    "HK": (852, "", (("2 3 4 5 6 7 8 9", 8, 8),)),
    "ID": (62, "0", (("2 3 4 5 6 7 9", 8, 11), ("8", 9, 12))),
    "IN": (91, "0?", (("1 2 3 4 5 6 7 8 9", 10, 10),)),
    "IT": (39, "", (("0", 6, 11), ("3", 9, 10), ("8", 6, 10))),
    "JP": (81, "0", (("1 2 3 4 5 6 7 8 9", 9, 9), ("50 70 80 90", 10, 10))),
    "KR": (82, "0", (("2", 8, 9), ("3 4 5 6 7", 8, 10), ("1", 9, 10))),
    "LK": (94, "0", (("1 2 3 4 5 6 7 8 9", 9, 9),)),
    "MX": (52, "", (("2 3 4 5 6 7 8 9", 10, 10),)),
    "MY": (60, "0", (("3 4 5 6 7 8 9", 8, 9), ("1", 9, 10))),
    "NL": (31, "0", (("1 2 3 4 5 6 7", 9, 9), ("8 9", 6, 9))),
    "NO": (47, "", (("2 3 4 5 6 7 8 9", 8, 8),)),
    "PG": (675, "", (("2 3 4 5 6 9", 7, 7), ("7 8", 8, 8))),
    "PH": (63, "0", (("2", 8, 9), ("3 4 5 6 7 8", 9, 9), ("9", 10, 10))),
    "PK": (92, "0", (("2 4 5 6 7 8 9", 9, 10), ("3", 10, 10))),
    "PL": (48, "", (("1 2 3 4 5 6 7 8 9", 9, 9),)),
    "PT": (351, "", (("2 3 6 7 8 9", 9, 9),)),
    "SE": (46, "0", (("1 2 3 4 5 6 8 9", 7, 9), ("7", 9, 9))),
    "SG": (65, "", (("3 6 8 9", 8, 8),)),
    "TH": (66, "0", (("2 3 4 5 7", 8, 8), ("6 8 9", 9, 9))),
    "TO": (676, "", (("2 3 4 5 6", 5, 5), ("7 8", 7, 7))),
    "VN": (84, "0", (("2", 10, 10), ("3 5 7 8 9", 9, 9))),
    "WS": (685, "", (("2 3 4 5 6", 5, 7), ("7 8", 7, 7))),
    "ZA": (27, "0", (("1 2 3 4 5 6 7 8", 9, 9),)),
}
#: A run of digits in groups, as numbers are written, with or without a calling code.
CANDIDATE = r"(?:\+|\(?\b)[0-9]{1,4}\)?(?:[ .-]?\(?[0-9]{1,5}\)?){1,6}\b"


def entries() -> list[tuple[str, int, int, int, str]]:
    """(beginning with the calling code, digits of the code, least, most, region), longest beginnings first."""
    rows = [(f"{code}{p}", len(str(code)), lo, hi, region) for region, (code, _, kinds) in PLANS.items() for ps, lo, hi in kinds for p in ps.split()]
    return sorted(rows, key=lambda r: (-len(r[0]), r[0]))


def _owner_sql() -> str:
    table = ",".join(f"{p}:{n} {lo} {hi} {region}" for p, n, lo, hi, region in entries())
    longest = max(len(e[0]) for e in entries())
    entry = "coalesce(" + ", ".join(f"try_element_at(t, left(d, {n}))" for n in range(longest, 1, -1)) + ")"
    fits = "CASE WHEN length(d) - int(e[0]) BETWEEN int(e[1]) AND int(e[2]) THEN e[3] END"
    return f"transform(array(str_to_map('{table}')), t -> transform(array(split({entry}, ' ')), e -> {fits})[0])[0]"


def owner(digits: Column) -> Column:
    """The region of a number that begins with its calling code; null if no plan has it or its length is wrong."""
    return by_sql(digits, "d", _owner_sql())


def international(written: Column, region: str) -> Column:
    """Digits with the calling code: those behind a plus, else ``region``'s code and what follows its trunk prefix; null without that."""
    code, trunk, _ = PLANS[region]
    plain = F.regexp_replace(F.regexp_replace(written, r"(?<=[0-9][ .-]?)\(0\)", ""), "[^0-9]", "")
    own = plain
    if trunk.endswith("?"):
        own = F.when(F.startswith(plain, F.lit(trunk[:-1])) & (F.length(plain) > min(lo for _, lo, _ in PLANS[region][2])), F.substring(plain, 2, 20)).otherwise(plain)
    elif trunk:
        own = F.when(F.startswith(plain, F.lit(trunk)), F.substring(plain, 2, 20))
    return F.when(F.startswith(written, F.lit("+")), plain).otherwise(F.concat(F.lit(str(code)), own))
