"""Deterministic notes with labels, from a table of integer keys: valid and broken check digits in turn.

Everything is arithmetic on the key, in SQL that Spark and DuckDB share, so both can build the same notes. A note is made
once, after its table is dealt out: the optimizer would otherwise make it again in filters that it pushes down to the table's few splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from lacuna.functions.checksums import MEDICARE_WEIGHTS, NHI_LETTERS, NHI_WEIGHTS

_FIRST = ("Jane", "Tama", "Ngaio", "Peter", "Moana", "Liam", "Olivia", "Noah", "Grace", "Rangi")
_LAST = ("Smith", "Cooper", "Parata", "Larsen", "Mason", "Patel", "Brown", "Foster", "Hughes", "Bell")
_STREETS = ("Rata Street", "Queen Street", "Elm Avenue", "Kowhai Road", "Harbour Drive", "Hill Lane")
_TOWNS = ("Hastings", "Auckland", "Newtown", "Brisbane", "Levin", "Perth")
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _pick(values: tuple[str, ...], k: str) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _text(x: str, width: int = 0) -> str:
    s = f"CAST({x} AS STRING)"
    return f"lpad({s}, {width}, '0')" if width else s


def _digit(s: str, i: int) -> str:
    return f"CAST(substring({s}, {i}, 1) AS INT)"


def nhi_sql(k: str) -> str:
    """Three letters, three digits, check digit; every fifth key has a wrong one."""
    number = _text(f"({k} * 37) % 1000", 3)
    at = [f"({k} % 24)", f"(({k} * 7) % 24)", f"(({k} * 13) % 24)"]
    letters = [f"substring('{NHI_LETTERS}', CAST({a} AS INT) + 1, 1)" for a in at]
    total = " + ".join([f"({a} + 1) * {w}" for a, w in zip(at, NHI_WEIGHTS, strict=False)] + [f"{_digit(number, i + 1)} * {NHI_WEIGHTS[3 + i]}" for i in range(3)])
    check = f"(11 - ({total}) % 11 + CASE WHEN {k} % 5 = 0 THEN 1 ELSE 0 END) % 10"
    return f"concat({', '.join(letters)}, {number}, {_text(check)})"


def sound_nhi_sql(k: str) -> str:
    """As ``nhi_sql``, but always valid: the last digit before the check digit is 1 where 0 would leave no check digit."""
    two = _text(f"({k} * 37) % 100", 2)
    at = [f"({k} % 24)", f"(({k} * 7) % 24)", f"(({k} * 13) % 24)"]
    letters = [f"substring('{NHI_LETTERS}', CAST({a} AS INT) + 1, 1)" for a in at]
    total = " + ".join([f"({a} + 1) * {w}" for a, w in zip(at, NHI_WEIGHTS, strict=False)] + [f"{_digit(two, i + 1)} * {NHI_WEIGHTS[3 + i]}" for i in range(2)])
    last = f"(CASE WHEN ({total}) % 11 < 2 THEN 1 ELSE 0 END)"
    return f"concat({', '.join(letters)}, {two}, {_text(last)}, {_text(f'11 - ({total} + {NHI_WEIGHTS[5]} * {last}) % 11')})"


def medicare_sql(k: str) -> str:
    body = f"concat({_text(f'2 + {k} % 5')}, {_text(f'({k} * 7919) % 10000000', 7)})"
    total = " + ".join(f"{_digit(body, i + 1)} * {w}" for i, w in enumerate(MEDICARE_WEIGHTS))
    return f"concat({body}, {_text(f'(({total}) + CASE WHEN {k} % 7 = 0 THEN 1 ELSE 0 END) % 10')}, {_text(f'1 + {k} % 9')})"


def ihi_sql(k: str) -> str:
    body = f"concat('800360', {_text(f'({k} * 104729) % 1000000000', 9)})"
    doubled = [f"(CASE WHEN {_digit(body, i)} > 4 THEN {_digit(body, i)} * 2 - 9 ELSE {_digit(body, i)} * 2 END)" if i % 2 else _digit(body, i) for i in range(1, 16)]
    return f"concat({body}, {_text(f'(10 - ({" + ".join(doubled)}) % 10 + CASE WHEN {k} % 6 = 0 THEN 1 ELSE 0 END) % 10')})"


def uuid_sql(k: str) -> str:
    part = lambda m, n: _text(f"({k} * {m}) % {10**n}", n)
    return f"concat({part(7919, 7)}, 'a-', {part(37, 4)}, '-4', {part(101, 3)}, '-8', {part(211, 3)}, '-', {part(104729, 11)}, 'f')"


def segments_sql(k: str = "k") -> list[tuple[str, str | None]]:
    """(SQL of a piece of the note, its label or None), in order."""
    date = f"concat({_text(f'1 + {k} % 31')}, '/', {_text(f'1 + ({k} * 5) % 12', 2)}, '/', {_text(f'1930 + {k} % 80')})"
    named = f"concat({_text(f'1 + {k} % 28')}, ' ', {_pick(_MONTHS, k)}, ' ', {_text(f'1990 + {k} % 30')})"
    iso = f"concat({_text(f'1950 + {k} % 60')}, '-', {_text(f'1 + {k} % 13', 2)}, '-', {_text(f'1 + {k} % 30', 2)})"
    return [
        ("'Patient: '", None),
        (f"concat({_pick(_FIRST, k)}, ' ', {_pick(_LAST, f'({k} + 3)')})", "PERSON"),
        ("concat(chr(10), 'NHI: ')", None), (nhi_sql(k), "NHI"),
        ("concat(chr(10), 'New NHI: ZBD', '42', 'KX', chr(10), 'Medicare: ')", None), (medicare_sql(k), "MEDICARE"),
        ("concat(chr(10), 'IHI: ')", None), (ihi_sql(k), "IHI"),
        ("concat(chr(10), 'Phone: ')", None), (f"concat('021 ', {_text(f'100 + ({k} * 17) % 900')}, ' ', {_text(f'1000 + ({k} * 29) % 9000')})", "PHONE"),
        ("concat(chr(10), 'or ')", None), (f"concat('+64 21 ', {_text(f'100 + ({k} * 19) % 900')}, ' ', {_text(f'1000 + ({k} * 31) % 9000')})", "PHONE"),
        ("concat(chr(10), 'or ')", None), (f"concat('04', {_text(f'10 + {k} % 90')}, ' ', {_text(f'100 + ({k} * 23) % 900')}, ' ', {_text(f'100 + ({k} * 41) % 900')})", "PHONE"),
        ("concat(chr(10), 'free ')", None), (f"concat('1300 ', {_text(f'100 + ({k} * 43) % 900')}, ' ', {_text(f'100 + ({k} * 47) % 900')})", "PHONE"),
        ("concat(chr(10), 'DOB: ')", None), (date, "DATE"),
        ("concat(', seen ')", None), (named, "DATE"),
        ("concat(' and ')", None), (iso, "DATE"),
        ("concat(chr(10), 'MRN: ')", None), (_text(f"100000 + ({k} * 7) % 900000"), "MRN"),
        ("concat(chr(10), 'Medical Record Number: ')", None), (f"concat('LA', {_text(f'100000 + ({k} * 11) % 900000')})", "ID"),
        ("concat(chr(10), 'SSN on card ')", None), (f"concat({_text(f'100 + {k} % 800')}, '-', {_text(f'10 + {k} % 89')}, '-', {_text(f'1000 + ({k} * 3) % 9000')})", "ID"),
        (f"CASE WHEN {k} % 2 = 0 THEN concat(chr(10), 'resource id ') ELSE concat(chr(10), 'trace of the device log in the ward, kept apart: ') END", None), (uuid_sql(k), "ID"),
        (f"concat(chr(10), 'Aged ')", None), (f"concat({_text(f'20 + {k} % 80')}, CASE WHEN {k} % 3 = 0 THEN ' yo' WHEN {k} % 3 = 1 THEN ' years old' ELSE 'y/o' END)", "AGE"),
        ("concat(chr(10), 'Address: ')", None), (f"concat({_text(f'1 + {k} % 400')}, ' ', {_pick(_STREETS, k)})", "LOCATION"),
        ("', '", None), (_pick(_TOWNS, k), "LOCATION"),
        ("' '", None), (_text(f"1000 + ({k} * 13) % 9000"), "POSTCODE"),
        ("concat(chr(10), 'Ward code 4021. Mail ')", None), (f"concat('user', {_text(k)}, '@clinic', {_text(f'{k} % 7')}, '.example.org')", "EMAIL"),
        ("concat(chr(10), 'Portal ')", None), (f"concat('https://portal.example.org/p/', {_text(k)})", "URL"),
        ("concat(chr(10), 'from host ')", None), (f"concat('10.', {_text(f'{k} % 300')}, '.', {_text(f'({k} * 3) % 256')}, '.7')", "IP"),
        (f"CASE WHEN {k} % 4 = 0 THEN concat(chr(10), 'Earlier: [REDACTED:NHI] [PHONE:0123456789].') ELSE concat(chr(10), 'Stable.') END", None),
    ]


def notes_sql(table: str = "customer", key: str = "c_custkey") -> str:
    """SELECT note_id, text for every row of the table."""
    return f"SELECT k AS note_id, concat({', '.join(s for s, _ in segments_sql())}) AS text FROM (SELECT CAST({key} AS BIGINT) AS k FROM {table}) AS keys"


def generated_notes(keys: DataFrame, key: str = "c_custkey") -> DataFrame:
    """(note_id, text, gold) with the labels of every labelled piece, valid or not."""
    from pyspark.sql import functions as F

    from lacuna.functions.spans import settled

    # pieces and where they end are plain columns, which are compiled; all that a generator holds is interpreted
    segments = segments_sql()
    k = keys.select(F.col(key).cast("long").alias("k"))
    pieces = k.select(F.col("k").alias("note_id"), *[F.expr(s).alias(f"s{i}") for i, (s, _) in enumerate(segments)])
    ends, at = [], F.lit(0)
    for i in range(len(segments)):
        at = at + F.length(f"s{i}")
        ends.append(at.alias(f"e{i}"))
    pieces = pieces.select("*", *ends)
    gold = [F.struct((F.col(f"e{i - 1}") if i else F.lit(0)).alias("start"), F.col(f"e{i}").alias("end"), F.lit(label).alias("type"), F.col(f"s{i}").alias("text")) for i, (_, label) in enumerate(segments) if label]
    text = F.concat(*[F.col(f"s{i}") for i in range(len(segments))])
    rendered = settled(pieces, "r", F.struct(text.alias("text"), F.array(*gold).alias("spans")))
    return rendered.select("note_id", F.col("r.text").alias("text"), F.col("r.spans").alias("gold"))


def shape_sql(k: str = "k") -> str:
    """Of every 30 keys one rich, one Australian and one sparse note; of the others five in nine are from New Zealand."""
    return f"CASE WHEN {k} % 30 = 0 THEN 'rich' WHEN {k} % 30 = 1 THEN 'au' WHEN {k} % 30 = 2 THEN 'sparse' WHEN {k} % 5 < 3 THEN 'nz' ELSE 'region_au' END"


def _kept(condition: str, parts: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
    return [(f"CASE WHEN {condition} THEN {s} ELSE '' END", label) for s, label in parts]


def shaped_segments_sql(k: str = "k") -> dict[str, list[tuple[str, str | None]]]:
    """Segments of each shape; optional ones are empty for some keys."""
    sound = f"(42 * {k} + 1)"  # no multiple of 6 or 7, which have wrong check digits
    nhi, medicare, ihi = sound_nhi_sql(k), medicare_sql(sound), ihi_sql(sound)
    person = f"concat({_pick(_FIRST, k)}, ' ', {_pick(_LAST, f'({k} + 3)')})"
    second = f"concat({_pick(_FIRST, f'({k} + 4)')}, ' ', {_pick(_LAST, k)})"
    date = f"concat({_text(f'1 + {k} % 28', 2)}, '/', {_text(f'1 + ({k} * 5) % 12', 2)}, '/', {_text(f'1930 + {k} % 70')})"
    nz_phone = f"concat('021 ', {_text(f'100 + ({k} * 17) % 900')}, ' ', {_text(f'1000 + ({k} * 29) % 9000')})"
    au_phone = f"concat('04', {_text(f'10 + {k} % 90')}, ' ', {_text(f'100 + ({k} * 23) % 900')}, ' ', {_text(f'100 + ({k} * 41) % 900')})"
    street, town = f"concat({_text(f'1 + {k} % 400')}, ' ', {_pick(_STREETS, k)})", _pick(_TOWNS, k)
    code, mrn = _text(f"1000 + ({k} * 13) % 9000"), _text(f"100000 + ({k} * 7) % 900000")
    line = lambda label, *pieces: [(f"concat(chr(10), '{label}')", None), *pieces]
    tail = [
        *line("DOB: ", (date, "DATE")),
        *_kept(f"{k} % 5 < 3", line("Email: ", (f"concat('user', {_text(k)}, '@clinic', {_text(f'{k} % 7')}, '.example.org')", "EMAIL"))),
        *_kept(f"{k} % 5 > 2", line("MRN: ", (mrn, "MRN"))),
        *_kept(f"{k} % 2 = 0", line("Address: ", (street, "LOCATION"), ("', '", None), (town, "LOCATION"), ("' '", None), (code, "POSTCODE"))),
        ("concat(chr(10), 'Seen today. Nothing acute. To call if worse.')", None),
    ]
    return {
        "rich": [("'Patient: '", None), (person, "PERSON"), *line("NHI: ", (nhi, "NHI")), *line("DOB: ", (date, "DATE")), *line("Phone: ", (nz_phone, "PHONE")), *line("Address: ", (street, "LOCATION"), ("', '", None), (town, "LOCATION"), ("' '", None), (code, "POSTCODE")), *line("MRN: ", (mrn, "MRN")), *line("Chest pain. Daughter ", (second, "PERSON")), ("' came along.'", None)],
        "au": [("'Name: '", None), (person, "PERSON"), *line("Medicare: ", (medicare, "MEDICARE")), *line("IHI: ", (ihi, "IHI")), *line("Phone: ", (au_phone, "PHONE")), *line("Address: ", (street, "LOCATION"), ("', '", None), (town, "LOCATION"), ("' '", None), (code, "POSTCODE")), *line("95-year-old, reviewed. DOB ", (date, "DATE"))],
        "sparse": [("'Patient '", None), (person, "PERSON"), ("' has no NHI on file. The entry ABC1234 is not valid.'", None)],
        "nz": [("'Patient: '", None), (person, "PERSON"), *line("NHI: ", (nhi, "NHI")), *line("Contact: ", (nz_phone, "PHONE")), *tail],
        "region_au": [("'Patient: '", None), (person, "PERSON"), *line("Medicare: ", (medicare, "MEDICARE")), *line("IHI: ", (ihi, "IHI")), *line("Contact: ", (au_phone, "PHONE")), *tail],
    }


def shaped_sql(table: str = "customer", key: str = "c_custkey") -> str:
    """SELECT note_id, shape, text for every row of the table."""
    cases = " ".join(f"WHEN shape = '{name}' THEN concat({', '.join(s for s, _ in parts)})" for name, parts in shaped_segments_sql().items())
    return f"SELECT k AS note_id, shape, CASE {cases} END AS text FROM (SELECT k, {shape_sql()} AS shape FROM (SELECT CAST({key} AS BIGINT) AS k FROM {table}) AS keys) AS shaped"


def shaped_notes(keys: DataFrame, key: str = "c_custkey") -> DataFrame:
    """(note_id, shape, text, gold): a corpus of five shapes whose labels are all valid identifiers."""
    from pyspark.sql import functions as F

    from lacuna.functions.spans import settled
    from lacuna.sources.notes import render_segments

    k = keys.select(F.col(key).cast("long").alias("k")).withColumn("shape", F.expr(shape_sql()))
    parts = F.lit(None)
    for name, segments in shaped_segments_sql().items():
        made = F.array(*[F.struct(F.expr(s).alias("text"), F.lit(label).cast("string").alias("label")) for s, label in segments])
        parts = F.when(F.col("shape") == name, F.filter(made, lambda s: s["text"] != "")).otherwise(parts)
    rendered = settled(k.select("k", "shape"), "r", render_segments(parts)).withColumnRenamed("k", "note_id")
    return rendered.select("note_id", "shape", F.col("r.text").alias("text"), F.col("r.spans").alias("gold"))


def invalid_identifiers(notes: DataFrame, gold_col: str = "gold") -> DataFrame:
    """(note_id, type, text) of labelled NHI, Medicare and IHI numbers that do not check out; none in a sound corpus."""
    from pyspark.sql import functions as F

    from lacuna.functions import checksums

    g = notes.select("note_id", F.explode(gold_col).alias("g")).select("note_id", "g.type", "g.text")
    new_form = F.regexp_like("text", F.lit("^[A-Z]{3}[0-9]{2}[A-Z]{2}$"))
    checks = {"NHI": checksums.nhi_valid(F.col("text")) | new_form, "MEDICARE": checksums.medicare_valid(F.col("text")), "IHI": checksums.ihi_valid(F.col("text"))}
    sound = F.lit(True)
    for kind, check in checks.items():
        sound = F.when(F.col("type") == kind, check).otherwise(sound)
    return g.where(~sound)


# Syllables of made-up names, towns and places of care, in two pools that share none: one to learn from, one to test on.
_POOLS = (
    (("Ba", "Der", "Fal", "Gri", "Hol", "Jas", "Kel", "Mar", "Nor", "Pet", "Ros", "Tam"), ("a", "bert", "da", "elle", "gan", "ick", "la", "man", "na", "son", "ton", "vik")),
    (("Al", "Cor", "Dav", "Ew", "Ian", "Lin", "Mo", "Ol", "Quen", "Ser", "Vic", "Wen"), ("ard", "beth", "cy", "din", "er", "fred", "ia", "kin", "lys", "or", "rick", "wyn")),
)
_TOWN_ENDS = (("bury", "ford", "ham", "port"), ("field", "mouth", "stead", "ville"))
_CARE_ENDS = (("Hospital", "Medical Centre", "Clinic"), ("Hospital", "Health Centre", "Clinic"))
#: Sentences with places for a person (P), a surname (S), a town (T), a street address (A) and a place of care (C); the second pool
#: has sentences of its own as well.
_SENTENCES = (
    ("Patient: {P}", "Name: {P}", "Seen with {P}, who lives in {T}.", "{P} was driven here from {T} by {P}.", "Referred by Dr {S} at {C}.", "{C} sent a letter to {P}.", "Address: {A}, {T} 4021", "Lives at {A}, {T}.", "Daughter {P} came along.", "Discussed with {P} and {P}.",
     "Continue Metformin and Panadol.", "No acute concerns. Reviewed in clinic today.", "Chest pain since Monday. Plan: bloods.", "NHI: ABC1235", "DOB: 12/04/1961", "Phone: 021 242 2679", "Moved from {T} to {T} in March.", "Admitted to {C} on Friday.", "The Patient feels well. Blood Pressure stable.", "MRN: 123456", "{P} declined the vaccine.", "Next review with Ms {S}.", "Email: a.b@example.org", "Medicare: 2341316424"),
    ("Next of kin: {P}", "Her neighbour {P} phoned from {T}.", "Prof {S} of {C} will advise.", "Wife {P} works in {T}.", "Home is {A}, {T}.", "Transferred from {C} to {C}.", "Patient {P} has no fever.", "Contact: 0410 877 925", "Stable. Advised to call if Symptoms worsen.", "Started Amoxicillin on Tuesday.", "IHI: 8003605255341923", "Spoke to {P} about Advance Care Planning."),
)


def prose_notes(keys: DataFrame, key: str = "c_custkey", pool: int = 0, sentences: int = 6) -> DataFrame:
    """(note_id, text, gold): lines of prose with made-up names. Pool 1 has syllables and sentences that pool 0 lacks, and some of its sentences."""
    from pyspark.sql import functions as F

    from lacuna.functions.spans import settled
    from lacuna.sources.notes import render_segments

    begins, ends = _POOLS[pool]
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    draw = lambda k, i: F.floor(F.pmod(F.xxhash64(k, F.lit(pool), i if isinstance(i, Column) else F.lit(i)), F.lit(1 << 40)))
    word = lambda n: F.concat(pick(begins, n), pick(ends, F.floor(n / 12)))
    road = lambda n: F.concat(word(n), F.lit(" "), pick(("Street", "Road", "Avenue", "Lane", "St", "Crescent"), F.floor(n / 144)))
    made = {
        "P": ("PERSON", lambda n: F.when(n % 7 == 0, F.concat(word(n), F.lit(" "), F.left(word(F.floor(n / 3)), F.lit(1)), F.lit(". "), word(F.floor(n / 144)))).otherwise(F.concat(word(n), F.lit(" "), word(F.floor(n / 144))))),
        "S": ("PERSON", word),
        "T": ("LOCATION", lambda n: F.concat(word(n), pick(_TOWN_ENDS[pool], F.floor(n / 144)))),
        "A": ("LOCATION", lambda n: F.concat((n % 700 + 1).cast("string"), F.lit(" "), road(F.floor(n / 700)))),
        "C": ("ORG", lambda n: F.concat(word(n), F.lit(" "), pick(_CARE_ENDS[pool], F.floor(n / 144)))),
    }
    known = _SENTENCES[0] if pool == 0 else _SENTENCES[1] + _SENTENCES[0][::3]

    def segment(piece, i):
        """Every second piece of a sentence cut at braces names what stands there."""
        n = draw(F.struct("note_id", "seat"), i)
        text, label = piece, F.lit(None).cast("string")
        for letter, (kind, make) in made.items():
            here = (i % 2 == 1) & (piece == letter)
            text, label = F.when(here, make(n)).otherwise(text), F.when(here, kind).otherwise(label)
        return F.struct(text.alias("text"), label.alias("label"))

    k = F.col(key).cast("long")
    rows = keys.select(k.alias("note_id"), F.posexplode(F.array(*[pick(known, draw(k, 1000 + i)) for i in range(sentences)])).alias("seat", "sentence"))
    pieces = F.filter(F.transform(F.split(F.concat("sentence", F.lit("\n")), "[{}]"), segment), lambda s: s["text"] != "")
    lines = rows.select("note_id", "seat", pieces.alias("parts")).groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("seat", "parts"))).alias("lines"))
    rendered = settled(lines, "r", render_segments(F.flatten(F.transform("lines", lambda x: x["parts"]))))
    return rendered.select("note_id", F.col("r.text").alias("text"), F.col("r.spans").alias("gold"))
