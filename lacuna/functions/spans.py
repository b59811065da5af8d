"""Spans as columns: the span type, and regular-expression search that keeps offsets.

A span is ``struct<start,end,type,text,score,source,recognizer,seq>``; start and end count code points
and are half open. ``seq`` is its place among all candidates of a note and breaks ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,type:string,text:string,score:double,source:string,recognizer:string,seq:int>"
SPANS = f"array<{SPAN}>"
#: A match: ``mid`` is where its second group begins, ``head`` and ``tail`` are the texts before and behind it.
_HIT = "struct<start:int,mid:int,end:int,head:string,tail:string>"

#: Items of an array that are folded at once, at least.
BLOCK = 64
#: Hits of a text that are placed without a fold, at most.
FEW = 16

MARK, SPLIT, STAND_IN = "\u0001", "\u0002", "\u0003"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    element_at() keeps the type of what it returns; get() and ``[0]`` work it out anew for each row, through all that is nested.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def by_sql(value: Column, name: str, sql: str) -> Column:
    """SQL in which ``name`` stands for the value. The parser makes it in one call, however large it is."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {sql}")), 1)


def _block_size(n: Column) -> Column:
    return F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n)).cast("int"))


def in_blocks(items: Column, body: Callable[[Column], Column]) -> Column:
    """An array of ``body`` of each run of about the square root of all items. Not for empty arrays.

    An array that grows inside a fold is copied at each step, and a substring is looked for from the text's
    beginning; over blocks both cost the square root of what they cost over all items.
    """
    return let(items, lambda x: let(_block_size(F.size(x)), lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / b).cast("int")), lambda j: body(F.slice(x, j * b + 1, b)))))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """A left fold that gives out items on its way: ``struct<state,out>``, where ``out`` is all that
    ``emit(state, item)`` gave (arrays of ``kind``) and ``state`` what ``step`` made of ``zero`` in the end."""
    none = lambda of: F.array().cast(f"array<{of}>")

    def inner(state: Column, block: Column) -> Column:
        begin = F.struct(state.alias("state"), none(kind).alias("out"))
        return F.aggregate(block, begin, lambda acc, item: F.struct(step(acc["state"], item).alias("state"), F.concat(acc["out"], emit(acc["state"], item)).alias("out")))

    outer = lambda acc, block: let(inner(acc["state"], block), lambda done: F.struct(done["state"].alias("state"), F.concat(acc["outs"], F.array(done["out"])).alias("outs")))
    begin = F.struct(zero.alias("state"), none(f"array<{kind}>").alias("outs"))
    return F.aggregate(in_blocks(items, lambda block: block), begin, outer, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["outs"]).alias("out")))


def finditer(text: Column, pattern: str, flags: str = "U", cut: bool = False) -> Column:
    """All matches, left to right, as ``array<struct<start,mid,end,head,tail>>``, in about the time of the search.

    With ``cut`` the pattern is two groups side by side and ``mid`` is where the second begins; else it is
    ``start``. The text is marked by one regexp_replace and the lengths between the marks are added up, so
    context such as word boundaries holds, which looking up extracted strings would lose. Texts without a
    match, as those with some, cost one search. Repeated groups in patterns have to be bounded: Java's matcher recurses on them.
    """
    marked = _marked(text, pattern, flags, f"{MARK}$1{SPLIT}$2{MARK}" if cut else f"{MARK}$0{MARK}")
    return by_sql(marked, "v", f"if(contains(v.marked, '\\u0001'), {_hits_sql(cut)}, cast(array() AS array<{_HIT}>))")


#: How a match's two groups are marked where one of them alone is the hit.
_PARTS = {"whole": f"{MARK}$0{MARK}", "first": f"{MARK}$1{MARK}$2", "second": f"$1{MARK}$2{MARK}"}


def find_spans(text: Column, pattern: str, flags: str, part: str, made: Callable[[str, str, str], str]) -> Column:
    """``made(start, end, text)``, in SQL, of all matches or of one of their two groups.

    As ``finditer``, but the items of a text with few hits are made from its pieces at once: each array in between would be made and copied anew.
    """
    marked = _marked(text, pattern, flags, _PARTS[part])
    many = f"transform({_hits_sql(False)}, h -> {made('h.start', 'h.end', 'h.tail')})"
    one = f"array({made('length(w[0])', '(length(w[0]) + length(w[1]))', 'w[1]')})"
    upto = lambda k: f"length(array_join(slice(w, 1, {k}), ''))"
    few = f"transform(sequence(1, size(w) - 2, 2), k -> {made(upto('k'), upto('(k + 1)'), 'w[k]')})"
    here = _let_sql("split(v.marked, '\\u0001', -1)", "w", f"CASE WHEN v.odd IS NOT NULL OR size(w) > {2 * FEW + 1} THEN {many} WHEN size(w) = 3 THEN {one} ELSE {few} END")
    return by_sql(marked, "v", f"if(contains(v.marked, '\\u0001'), {here}, array())")


def _marked(text: Column, pattern: str, flags: str, marks: str) -> Column:
    """``struct<marked,odd>``: the text with its matches marked, and the text itself if it has marks of its own, which are replaced in the other."""
    of = lambda plain, odd: F.struct(F.regexp_replace(plain, F.lit(f"(?{flags}){pattern}"), F.lit(marks)).alias("marked"), odd.alias("odd"))
    # most texts have none of the marks, and translate() takes longer than many a search
    return F.when(F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(SPLIT)), of(F.translate(text, MARK + SPLIT, STAND_IN * 2), text)).otherwise(of(text, F.lit(None).cast("string")))


# The fold of finditer, as scan() and near_each() have it, but written in SQL: a plan has dozens of them, and the parser makes each in one call.


def _let_sql(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks_sql(items: str, body: str) -> str:
    """``body`` of each block ``q`` of the items."""
    each = _let_sql("slice(x, j * n + 1, n)", "q", body)
    blocks = _let_sql(f"greatest({BLOCK}, int(ceil(sqrt(size(x)))))", "n", f"transform(sequence(0, int(floor((size(x) - 1) / n))), j -> {each})")
    return _let_sql(items, "x", blocks)


def _hits_sql(cut: bool) -> str:
    """Hits of ``v.marked``; a text with the marks themselves gets its hits' texts from where they stand in ``v.odd``."""
    mark, split = r"'\u0001'", r"'\u0002'"
    less, at = ("if(c.s.inside, 1, 0)", f"instr(i, {split})") if cut else ("0", "1")
    head, tail = (f"left(i, {at} - 1)", f"substring(i, {at} + 1, length(i))") if cut else ("''", "i")
    hit = f"named_struct('start', c.s.at, 'mid', int(c.s.at + {at} - 1), 'end', int(c.s.at + length(i) - {less}), 'head', {head}, 'tail', {tail})"
    state = f"named_struct('at', int(c.s.at + length(i) - {less}), 'inside', not c.s.inside)"
    none = f"cast(array() AS array<{_HIT}>)"
    fold = f"aggregate(q, named_struct('s', a.s, 'o', {none}), (c, i) -> named_struct('s', {state}, 'o', if(c.s.inside, concat(c.o, array({hit})), c.o)))"
    outer = f"(a, q) -> {_let_sql(fold, 'd', "named_struct('s', d.s, 'o', concat(a.o, array(d.o)))")}"
    zero = f"named_struct('s', named_struct('at', 0, 'inside', false), 'o', cast(array() AS array<array<{_HIT}>>))"
    many = f"aggregate({_blocks_sql('w', 'q')}, {zero}, {outer}, a -> flatten(a.o))"
    # of few hits each counts what stands before it, which takes far fewer steps than a fold; hits are every second part
    ahead = "int(length(array_join(slice(w, 1, k), ''))" + (" - (k - 1) div 2)" if cut else ")")
    placed = _let_sql(f"named_struct('s', named_struct('at', {ahead}, 'inside', true), 'i', w[k])", "c", hit.replace("(i", "(c.i"))
    few = f"transform(sequence(1, size(w) - 2, 2), k -> {placed})".replace("instr(i,", "instr(c.i,").replace("'tail', i)", "'tail', c.i)")
    hits = _let_sql(f"split(v.marked, {mark}, -1)", "w", f"if(size(w) <= {2 * FEW + 1}, {few}, {many})")
    own = lambda start, end: f"substring(p.t, h.{start} - p.base + 1, h.{end} - h.{start})"
    place = "named_struct('base', q[0].start, 't', substring(v.odd, q[0].start + 1, element_at(q, -1).end - q[0].start))"
    again = _blocks_sql("z", _let_sql(place, "p", f"transform(q, h -> named_struct('start', h.start, 'mid', h.mid, 'end', h.end, 'head', {own('start', 'mid')}, 'tail', {own('mid', 'end')}))"))
    return f"if(v.odd IS NULL, {hits}, {_let_sql(hits, 'z', f'if(size(z) > 0, flatten({again}), z)')})"


def near_each(text: Column, items: Column, body: Callable[[Column, Column, Column], Column], before: int = 0, after: int = 0) -> Column:
    """``body(item, local, base)`` of each of sorted items with ``start`` and ``end``: ``local`` is a part of the
    text from ``base`` on, with all of a block's items and so many characters around them."""

    def block(own: Column) -> Column:
        base = F.greatest(F.element_at(own, 1)["start"] - before, F.lit(0))
        end = F.array_max(F.transform(own, lambda i: i["end"])) + after
        return let(F.struct(base.alias("base"), piece(text, base, end).alias("local")), lambda p: F.transform(own, lambda i: body(i, p["local"], p["base"])))

    return F.flatten(in_blocks(items, block))


def filter_near(text: Column, items: Column, keep: Callable[[Column, Column, Column], Column], before: int, after: int) -> Column:
    """Of sorted items those whose surroundings ``keep(item, local, base)`` accepts."""
    # so few substrings cost less than the arrays of blocks
    few = F.filter(items, lambda i: keep(i, text, F.lit(0)))
    judged = near_each(text, items, lambda i, local, base: F.struct(i.alias("item"), keep(i, local, base).alias("keep")), before, after)
    kept = F.transform(F.filter(judged, lambda j: j["keep"]), lambda j: j["item"])
    return F.when(F.size(items) <= FEW, few).otherwise(kept)


def piece(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def span_sql(kind: str, score: float, recognizer: str, source: str = "rule") -> Callable[[str, str, str], str]:
    """SQL of a span, from that of its start, end and text."""
    return lambda start, end, text: f"named_struct('start', int({start}), 'end', int({end}), 'type', '{kind}', 'text', {text}, 'score', double({score}), 'source', '{source}', 'recognizer', '{recognizer}', 'seq', 0)"


def make_spans(hits: Column, start: str, end: str, text: str, span: Callable[[str, str, str], str]) -> Column:
    """Spans of hits; ``start``, ``end`` and ``text`` say in SQL what of a hit ``h`` they are, ``span`` is a ``span_sql``."""
    return F.call_function("transform", hits, F.expr(f"h -> {span(start, end, text)}"))


def first_of_equal_bounds(*spans: Column) -> Column:
    """All spans in order, without those whose bounds an earlier one has."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
    keyed = lambda x: F.transform(x, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"), s.alias("span")))
    first = lambda k: F.filter(k, lambda x, i: (i == 0) | ~same(x, F.element_at(k, F.greatest(i, F.lit(1)))))
    again = lambda k: F.array_sort(F.transform(first(k), lambda x: F.struct(x["i"].alias("i"), x["span"].alias("span"))))
    bounds = lambda x: F.transform(x, lambda s: s["start"].cast("long") * F.lit(1 << 32) + s["end"])
    differ = lambda x: F.size(F.array_distinct(bounds(x))) == F.size(x)
    return let(F.concat(*spans), lambda x: F.when((F.size(x) < 2) | differ(x), x).otherwise(F.transform(let(F.array_sort(keyed(x)), again), lambda k: k["span"])))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once, whatever is built on it.

    The optimizer copies expressions into the projections and filters above them, and spans are far too
    large for that; it copies nothing through a generator, here one of a single row.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def numbered(spans: Column) -> Column:
    return F.transform(spans, lambda s, i: s.withField("seq", i.cast("int")))
