"""Licence scan by a positional index of rare words. DataFrame functions only.

* Base: every place where the words of a phrase stand one after the other.
* A notice is a place where at least ``SHARE`` of a template's words stand at their relative positions, and its
  mandatory key phrase stands there in full.
* The words of all templates are ranked by IDF over the whole table. Each template is indexed under its
  rarest word places, ``AGREE`` more than may be missing, so a notice has at least ``AGREE`` of them.
* The words of a file that the index has, its licence words of highest IDF, are looked up with their places in
  the file. Each gives its templates' postings (template, place in it), and so where the template would
  begin; beginnings that ``AGREE`` postings share are the intersection by relative position. Only there
  is the key phrase verified and the share of words counted.

Words are runs of [0-9a-z] and characters beyond ASCII, A-Z lowered. A text is split into words once, and each
word costs one look into hash buckets, however many templates there are; what follows runs for the
few texts that have an index word. Row by row; the one shuffle is the count of licence words (partial
sums of at most as many keys as the templates have words).

Score: of the best notice half the share of its words, and 0.5; 0.5 if there are base places only, else 0.

Defined cases: null or empty texts have no words, no places, empty labels and score 0; a row without an id is scanned too; repeated
rows are scanned alike; words of equal IDF go by their place in the template; of notices all labels are given and the best share; a
text cut off within a notice counts the words it has; very long texts cost time in proportion; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.spans import settled
from lacuna.llm.url_rules import LOWER, UPPER, lowered

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE, AGREE = 0.8, 2
#: Words of all templates together; the index is a literal of the plan.
WORDS = 200_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Stands in ``text`` and has to stand in the file.
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)

    @property
    def least(self) -> int:
        """Words that a notice has at least."""
        return math.ceil(SHARE * len(self.words) - 1e-9)


# Phrases and labels that every scan has, and notices of public licences in words as above.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the {0} as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {0} for more details"
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "in compliance with the license"),
    Template("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission is hereby granted free of charge"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-3.0", _GNU.format("gnu general public license", "3"), "gnu general public license"),
    Template("gpl-2.0", _GNU.format("gnu general public license", "2"), "either version 2 of the license"),
    Template("gpl-2.0", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", "general public license version 2 june 1991"),
    Template("lgpl", _GNU.format("gnu lesser general public license", "3"), "gnu lesser general public license"),
    Template("agpl", _GNU.format("gnu affero general public license", "3"), "gnu affero general public license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
)


def _words(text: Column) -> Column:
    """The words of a text. ``lower`` is quick, and agrees on ASCII but for two letters beyond it that become ASCII ones."""
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.array_remove(F.split(F.when(odd, lowered(text)).otherwise(F.lower(text)), NOT_WORD), "")


def _buckets(values: dict[str, list]) -> list[list]:
    n = 1 << (4 * len(values) + 1).bit_length()
    out: list[list] = [[] for _ in range(n)]
    for word, x in sorted(values.items()):
        out[crc32(word.encode()) % n].append((word, x))
    return out


def _bucket(word: Column, n: int) -> Column:
    return (F.pmod(F.crc32(word.cast("binary")), F.lit(n)) + 1).cast("int")


def _known(words: Column, vocabulary: set[str]) -> Column:
    """The words that a vocabulary has, by one look into its buckets each."""
    buckets = _buckets({w: [] for w in vocabulary})
    index = F.array(*[F.array(*[F.lit(w) for w, _ in b]).cast("array<string>") for b in buckets])
    return F.filter(words, lambda w: F.array_contains(F.element_at(index, _bucket(w, len(buckets))), w))


def rarity(texts: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF of the templates' words over the table."""
    vocabulary = {w for t in templates for w in t.words}
    found = texts.select(F.explode(F.concat(F.array_distinct(_known(F.col("words"), vocabulary)), F.array(F.lit("")))).alias("w"))
    seen = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}  # a row for each licence word
    total = seen.get("", 0)
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}


def postings(templates, idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """(template, place) under each word of the index."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        words = template.words
        anchors = len(words) - template.least + AGREE
        for place in sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:anchors]:
            out.setdefault(words[place], []).append((t, place))
    return out


def _candidates(words: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """Sorted (template, beginning) of each posting that a word of the file has, as ``array<struct<t,at>>``."""
    kind = "struct<t:int,at:int>"
    buckets = _buckets(index)
    entry = lambda w, x: F.struct(F.lit(w).alias("w"), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("at")) for t, p in x]).cast(f"array<{kind}>").alias("p"))
    table = F.array(*[F.array(*[entry(w, x) for w, x in b]).cast(f"array<struct<w:string,p:array<{kind}>>>") for b in buckets])
    here = lambda w: F.filter(F.element_at(table, _bucket(w, len(buckets))), lambda e: e["w"] == w)
    looked = lambda w, i: F.transform(F.flatten(F.transform(here(w), lambda e: e["p"])), lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("at")))
    return F.array_sort(F.flatten(F.transform(words, looked)))


def _notices(words: Column, votes: Column, templates) -> Column:
    """Verified (template, beginning, words found there) of sorted candidates."""
    last = F.size(votes) - 1
    # the first of each run of equal ones that goes on for AGREE
    agreed = F.filter(votes, lambda v, k: ((k == 0) | (F.get(votes, k - 1) != v)) & (k + AGREE - 1 <= last) & (F.get(votes, k + AGREE - 1) == v))
    texts = F.array(*[F.array(*map(F.lit, t.words)) for t in templates])
    keys = F.array(*[F.array(*map(F.lit, t.key.split())) for t in templates])
    key_at, least = (F.array(*[F.lit(getattr(t, c)) for t in templates]) for c in ("key_at", "least"))
    of = lambda a, v: F.get(a, v["t"])
    hits = lambda a, first: F.size(F.filter(a, lambda x, j: F.coalesce(F.get(words, first + j) == x, F.lit(False))))
    whole = F.filter(agreed, lambda v: hits(of(keys, v), v["at"] + of(key_at, v)) == F.size(of(keys, v)))
    counted = F.transform(whole, lambda v: F.struct(v["t"].alias("t"), v["at"].alias("at"), hits(of(texts, v), v["at"]).alias("n")))
    return F.filter(counted, lambda v: v["n"] >= of(least, v))


def places(words: Column, phrase: str) -> Column:
    """Where the phrase starts, in words from 0."""
    first, *rest = phrase.split()
    same = lambda w, i: (w == first) & F.coalesce(F.get(words, i + 1) == rest[0], F.lit(False)) & (F.lit(True) if len(rest) == 1 else F.coalesce(F.get(words, i + 2) == rest[1], F.lit(False)))
    return F.filter(F.transform(words, lambda w, i: F.when(same(w, i), i.cast("long"))), lambda i: i.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES, notices: bool = True) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices) of every row.

    ``base`` phrases have two or three words. ``notices`` are (label, first word, share), if wanted.
    """
    if sum(len(t.words) for t in templates) > WORDS:
        raise ValueError("too many templates for a literal")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = settled(texts, "words", _words(F.col("text"))).select("doc_id", "words")
    index = postings(templates, rarity(texts, templates))
    none = F.array().cast("array<long>")
    common = [p.split()[-1] for p, _ in base]  # a file without the last word of a phrase has no place of it
    found = settled(texts, "known", _known(F.col("words"), {*index, *common}))
    for i, (p, _) in enumerate(base):
        found = settled(found, f"p{i}", F.when(F.array_contains("known", common[i]), places(F.col("words"), p)).otherwise(none))
    no_votes = F.array().cast("array<struct<t:int,at:int>>")
    found = settled(found, "votes", F.when(F.size("known") >= AGREE, _candidates(F.col("words"), index)).otherwise(no_votes))
    found = settled(found, "hits", F.when(F.size("votes") >= AGREE, _notices(F.col("words"), F.col("votes"), templates)).otherwise(F.array().cast("array<struct<t:int,at:int,n:int>>")))
    every = F.concat(*[F.col(f"p{i}") for i in range(len(base))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, (_, x) in enumerate(base)]))
    labels, sizes = F.array(*[F.lit(t.label) for t in templates]), F.array(*[F.lit(len(t.words)) for t in templates])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    share = lambda h: h["n"].cast("double") / F.get(sizes, h["t"])
    rows = [F.transform("hits", lambda h: F.struct(F.get(labels, h["t"]).alias("label"), h["at"].alias("first"), share(h).alias("share"))).alias("notices")]
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("hits", lambda h: F.get(labels, h["t"])))).alias("labels"),
        F.when(F.size("hits") > 0, 0.5 + 0.5 * F.array_max(F.transform("hits", share))).when(F.size(every) > 0, 0.5).otherwise(0.0).alias("score"),
        *(rows if notices else []),
    )


def oracle(base=BASE, templates=TEMPLATES, table: str = "documents") -> str:
    """The same in DuckDB: every phrase, and every template behind its key phrase, tried at every word, without an index."""
    def at(phrase: str) -> str:
        return "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split())) + ")"

    def share(t: Template) -> str:
        words = "[" + ", ".join(f"'{x}'" for x in t.words) + "]"
        count = f"len(list_filter(range({len(t.words)}), lambda j: i - {t.key_at} + j >= 0 AND w[i - {t.key_at} + j + 1] = {words}[j + 1]))"
        return f"list_max(list_filter(list_transform({at(t.key)}, lambda i: {count}), lambda n: n >= {t.least}))::DOUBLE / {len(t.words)}"

    def labels(pairs) -> str:
        return ", ".join(f"CASE WHEN {c} THEN '{x}' END" for c, x in pairs)

    b = [(f"len(p{i}) > 0", x) for i, (_, x) in enumerate(base)]
    t = [(f"t{i} IS NOT NULL", x.label) for i, x in enumerate(templates)]
    joined = lambda pairs: f"array_to_string(list_sort(list_distinct(list_filter([{labels(pairs)}], lambda x: x IS NOT NULL))), ',')"
    every = " || ".join(f"p{i}" for i in range(len(base)))
    best = f"list_max([{', '.join(f't{i}' for i in range(len(templates)))}])"
    return f"""
WITH a AS (SELECT doc_id, regexp_replace(' ' || translate(coalesce(text, ''), '{UPPER}', '{LOWER}') || ' ', '{NOT_WORD}', ' ', 'g') AS norm FROM {table}),
b AS (SELECT doc_id, list_filter(string_split(norm, ' '), lambda x: x <> '') AS w FROM a),
c AS (SELECT *, {", ".join(f"{at(p)} AS p{i}" for i, (p, _) in enumerate(base))}, {", ".join(f"{share(x)} AS t{i}" for i, x in enumerate(templates))} FROM b),
d AS (SELECT *, {every} AS every, {best} AS best FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
  {joined(b)} AS base_labels, {joined(b + t)} AS labels,
  CASE WHEN best IS NOT NULL THEN 0.5::DOUBLE + 0.5::DOUBLE * best WHEN len(every) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM d
"""
