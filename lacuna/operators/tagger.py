"""Entity tagger: an averaged structured perceptron with Viterbi decoding, trained over partitions.

Text is cut into lines, and lines into runs of word characters and single marks. Each token has some twenty
features (words, shapes, beginnings and ends of it and its neighbours) as 64-bit hashes, worked out by numpy for a
block of lines at once. Training is iterative parameter mixing: in each epoch every partition runs the
perceptron over its own notes from the common weights, an aggregate by feature sums what they changed, and the
means are the next epoch's weights. The model is the mean over all steps, kept as a sorted array of hashes with a
row of weights for each; models of more than ``FEATURES`` rows are refused, which bounds what is sent to tasks.
Notes are dealt by their id and ordered by it, so a partition that runs again changes the same weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from types import MappingProxyType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("PERSON", "LOCATION", "ORG")
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
N = len(TAGS)
FEATURES = 1 << 20
SCORE = 0.85
#: Tokens that are tagged at once, about.
BLOCK_TOKENS = 1 << 15
#: Notes that are learnt from at once, and lines of them that are tagged ahead at most.
NOTES, RUN = 256, 512
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Attributes of a token, and the (place, attribute) groups that make a feature.
WORD, SHAPE, BEGIN, END, SHORT = range(5)
TEMPLATES = (
    *(((d, WORD),) for d in (-2, -1, 0, 1, 2)), *(((d, SHAPE),) for d in (-2, -1, 0, 1, 2)), ((0, BEGIN),), ((0, END),), ((1, END),), ((-1, END),),
    ((-1, WORD), (0, SHORT)), ((0, SHORT), (1, WORD)), ((-1, SHORT), (0, SHORT)), ((0, SHORT), (1, SHORT)), ((-1, SHORT), (0, SHORT), (1, SHORT)), ((-2, WORD), (-1, WORD), (0, SHORT)),
)
_NONE = -1e9
_NARROW = re.compile(r"(.)\1+")


def _allowed() -> np.ndarray:
    """Whether tag b may follow tag a; the last row stands for the beginning of a line."""
    ok = np.ones((N + 1, N), bool)
    for b, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, b] = [a.endswith(tag[1:]) and a != "O" for a in TAGS] + [False]
    return ok


ALLOWED = _allowed()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _shape(word: str) -> str:
    return "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "x" if c.isalpha() else c for c in word)


def attributes(word: str) -> tuple[int, ...]:
    shape = _shape(word)
    code = lambda s, kind: zlib.crc32(s.encode(), kind) | (kind + 1) << 32
    return code(word.lower(), WORD), code(shape[:12], SHAPE), code(word[:3].lower(), BEGIN), code(word[-3:].lower(), END), code(_NARROW.sub(r"\1", shape)[:6], SHORT)


class Lines:
    """Tokens of the lines of some texts: ``first`` bounds the lines, ``of`` is the text of each line."""

    def __init__(self, texts: Iterable[str], cache: dict):
        spans, first, of, rows = [], [0], [], []
        for k, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                for m in _TOKEN.finditer(line):
                    spans.append((at + m.start(), at + m.end()))
                    word = m.group()
                    if word not in cache:
                        if len(cache) > 1 << 18:
                            cache.clear()
                        cache[word] = attributes(word)
                    rows.append(cache[word])
                if len(spans) > first[-1]:
                    first.append(len(spans))
                    of.append(k)
                at += len(line) + 1
        self.spans, self.first, self.of = np.array(spans, np.int64).reshape(-1, 2), np.array(first), np.array(of, np.int64)
        self._rows = np.array(rows, np.uint64).reshape(-1, 5)

    def features(self) -> np.ndarray:
        """A row of hashes for each token; places beyond the line's ends have a code of their own."""
        n, line = len(self._rows), np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        shifted = {}
        for d in range(-2, 3):
            at = np.arange(n) + d
            inside = (at >= 0) & (at < n)
            inside[inside] = line[at[inside]] == line[inside]
            shifted[d] = np.where(inside[:, None], self._rows[np.clip(at, 0, max(n - 1, 0))], np.uint64(7)) if n else self._rows
        out = np.empty((n, len(TEMPLATES)), np.uint64)
        with np.errstate(over="ignore"):
            for t, parts in enumerate(TEMPLATES):
                h = np.full(n, t + 1, np.uint64)
                for d, a in parts:
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + shifted[d][:, a])
                out[:, t] = h
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of lines side by side: scores (lines, longest, tags), moves (tags and the beginning, tags)."""
    lines, longest, _ = scores.shape
    moves = np.where(ALLOWED, moves, _NONE)
    best, back = scores[:, 0] + moves[N], np.zeros((longest, lines, N), np.int8)
    for t in range(1, longest):
        way = best[:, :, None] + moves[None, :N]
        back[t] = way.argmax(axis=1)
        best = np.where((t < lengths)[:, None], way.max(axis=1) + scores[:, t], best)
    tags = np.zeros((lines, longest), np.int64)
    own = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        tags[:, t] = own
        own = np.where((t < lengths) & (t > 0), back[t][np.arange(lines), own], own)
    return tags


def best_tags(scores: np.ndarray, lines: Lines, moves: np.ndarray) -> np.ndarray:
    """Best tags of all lines, lines of about equal length side by side."""
    out, size = np.zeros(len(lines.spans), np.int64), np.diff(lines.first)
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and size[order[upto]] * (upto - at + 1) <= BLOCK_TOKENS and size[order[upto]] <= 2 * size[order[at]]:
            upto += 1
        some = order[at:upto]
        place = lines.first[some][:, None] + np.arange(size[some[-1]])
        inside = np.arange(size[some[-1]]) < size[some][:, None]
        block = scores[np.where(inside, place, 0)]
        out[place[inside]] = viterbi(block, size[some], moves)[inside]
        at = upto
    return out


@dataclass
class Tagger:
    """``keys`` sorted, a row of ``weights`` for each and one of zeros behind them; ``moves`` weighs neighbouring tags."""

    keys: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, features)
        known = np.zeros(features.shape, bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == features
        return self.weights[np.where(known, at, len(self.keys))].sum(axis=1)

    def tags(self, lines: Lines) -> np.ndarray:
        return best_tags(self.scores(lines.features()), lines, self.moves)

    def detect(self, texts: list[str]) -> list[list[dict]]:
        """For ``ner.model_spans``."""
        cache, out = {}, []
        at = 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) <= 1 << 18):
                held += len(texts[upto])
                upto += 1
            lines = Lines(texts[at:upto], cache)
            found = [[] for _ in range(upto - at)]
            for k, a, b, kind in spans_of(self.tags(lines), lines):
                found[k].append({"start": a, "end": b, "type": kind, "score": SCORE, "recognizer": "tagger"})
            out += found
            at = upto
        return out


def spans_of(tags: np.ndarray, lines: Lines) -> Iterator[tuple[int, int, int, str]]:
    """(text, start, end, type) of runs of tags within a line."""
    line = np.repeat(np.arange(len(lines.of)), np.diff(lines.first))
    i = 0
    for i in np.flatnonzero(tags % 2 == 1).tolist():  # beginnings have odd numbers
        j = i + 1
        while j < len(tags) and tags[j] == tags[i] + 1 and line[j] == line[i]:
            j += 1
        yield int(lines.of[line[i]]), int(lines.spans[i, 0]), int(lines.spans[j - 1, 1]), KINDS[(int(tags[i]) - 1) // 2]


def gold_tags(lines: Lines, gold: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Tags of tokens that labelled spans touch."""
    tags = np.zeros(len(lines.spans), np.int64)
    line = np.repeat(np.arange(len(lines.of)), np.diff(lines.first))
    bounds = np.searchsorted(lines.of[line], np.arange(len(gold) + 1))
    for k, own in enumerate(gold):
        a, b = bounds[k], bounds[k + 1]
        for start, end, kind in own:
            if kind in KINDS:
                i, j = a + np.searchsorted(lines.spans[a:b, 1], start, "right"), a + np.searchsorted(lines.spans[a:b, 0], end, "left")
                if i < j:
                    tags[i:j] = TAGS.index(f"I-{kind}")
                    tags[i] -= 1
    return tags


class _Learner:
    """The perceptron of one shard in one epoch: weights, and their sums over steps by the usual trick of counting changes once."""

    def __init__(self, model: Tagger):
        self.model, self.steps, self.wrong = model, 1, 0
        self.keys = np.zeros(0, np.uint64)
        self.change, self.late = np.zeros((0, N)), np.zeros((0, N))
        self.moves, self.late_moves = np.zeros((N + 1, N)), np.zeros((N + 1, N))

    def learn(self, lines: Lines, gold: np.ndarray) -> None:
        features = lines.features()
        own, at = np.unique(features, return_inverse=True)
        at = at.reshape(features.shape)
        base = self.model.scores(own[:, None])
        change, late = np.zeros((len(own), N)), np.zeros((len(own), N))
        known = np.searchsorted(own, self.keys)
        here = (known < len(own)) & (own[np.minimum(known, len(own) - 1)] == self.keys) if len(own) else np.zeros(len(self.keys), bool)
        change[known[here]], late[known[here]] = self.change[here], self.late[here]
        first, size, line, run = lines.first, np.diff(lines.first), 0, 8
        while line < len(size):
            # a run of lines by the weights as they are: those before its first wrong line are as one by one, so only that one is learnt from
            upto = min(line + run, len(size))
            place = first[line:upto, None] + np.arange(size[line:upto].max())
            inside = np.arange(place.shape[1]) < size[line:upto, None]
            rows = at[np.where(inside, place, first[line])]
            tags = viterbi(base[rows].sum(axis=2) + change[rows].sum(axis=2), size[line:upto], self.model.moves + self.moves)
            wrong = ((tags != gold[np.where(inside, place, 0)]) & inside).any(axis=1)
            right = int(wrong.argmax()) if wrong.any() else upto - line
            self.steps += right
            line += right
            if line < upto:
                a, b = int(first[line]), int(first[line + 1])
                self._correct(at[a:b], gold[a:b], tags[right, : b - a], change, late)
                self.steps += 1
                line += 1
            run = min(max(2 * right, 2), RUN)
        keep = np.concatenate((self.keys[~here], own))
        order = np.argsort(keep)
        change, late = np.concatenate((self.change[~here], change))[order], np.concatenate((self.late[~here], late))[order]
        used = change.any(axis=1) | late.any(axis=1)
        self.keys, self.change, self.late = keep[order][used], change[used], late[used]

    def _correct(self, rows: np.ndarray, truth: np.ndarray, tags: np.ndarray, change: np.ndarray, late: np.ndarray) -> None:
        """Weights of a wrong line: those of its true tags up, those of the tags it got down."""
        self.wrong += 1
        for i in np.flatnonzero(tags != truth).tolist():
            for tag, sign in ((truth[i], 1.0), (tags[i], -1.0)):
                np.add.at(change[:, tag], rows[i], sign)
                np.add.at(late[:, tag], rows[i], sign * self.steps)
        for path, sign in ((truth, 1.0), (tags, -1.0)):
            pairs = np.concatenate(([N], path[:-1])), path
            np.add.at(self.moves, pairs, sign)
            np.add.at(self.late_moves, pairs, sign * self.steps)

    def any_wrong(self, lines: Lines, gold: np.ndarray) -> bool:
        """Whether a line is wrong by the weights as they are, which are added up as ``learn`` adds them."""
        changed = Tagger(self.keys, np.concatenate((self.change, np.zeros((1, N)))), self.moves)
        features = lines.features()
        scores = self.model.scores(features) + changed.scores(features)
        return bool((best_tags(scores, lines, self.model.moves + self.moves) != gold).any())

    def rows(self, shard: int = 0, read: Mapping[int, int] = MappingProxyType({})) -> pa.RecordBatch:
        """Weights and moves, the latter keyed by their place, below 256; then the steps, and what was read of each part."""
        keys = np.concatenate((self.keys.astype(np.int64), np.arange(N + 1)))
        change, late = np.concatenate((self.change, self.moves)), np.concatenate((self.late, self.late_moves))
        weights = np.concatenate((change, late), axis=1).tolist()
        rest = [[float(self.steps), float(self.wrong)], *[[float(n)] for n in read.values()]]
        kinds = [_WEIGHT] * len(keys) + [_STEPS] + [_READ] * len(read)
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(kinds), pa.int32()), pa.array(kinds, pa.int32()), pa.array([*keys.tolist(), 0, *read], pa.int64()), pa.array(weights + rest, pa.list_(pa.float64()))], names=["shard", "kind", "key", "numbers"])

    def changes(self) -> Iterator[tuple[int, np.ndarray]]:
        """What changed, and its mean over the steps."""
        for keys, change, late in ((self.keys.astype(np.int64), self.change, self.late), (np.arange(N + 1), self.moves, self.late_moves)):
            yield from zip(keys.tolist(), np.concatenate((change, change - late / self.steps), axis=1), strict=True)

    @classmethod
    def of(cls, model: Tagger, rows: pa.Table) -> tuple["_Learner", dict[int, int]]:
        """The learner whose ``rows`` these are, and what it read."""
        self = cls(model)
        kind, key = rows.column("kind").to_numpy(), rows.column("key").to_numpy()
        numbers = rows.column("numbers").to_pylist()
        own = np.flatnonzero(kind == _WEIGHT)
        table = np.array([numbers[i] for i in own.tolist()])
        moves = (key[own] >= 0) & (key[own] <= N)
        at = key[own][moves]
        self.moves[at], self.late_moves[at] = table[moves, :N], table[moves, N:]
        keys = key[own][~moves].astype(np.uint64)
        order = np.argsort(keys)
        self.keys, self.change, self.late = keys[order], table[~moves, :N][order], table[~moves, N:][order]
        self.steps, self.wrong = map(int, numbers[int(np.flatnonzero(kind == _STEPS)[0])])
        return self, {int(key[i]): int(numbers[i][0]) for i in np.flatnonzero(kind == _READ).tolist()}


_WEIGHT, _STEPS, _READ = range(3)
#: Notes of a shard that one task learns from in its first round; each round takes four times as many.
ROUND = 4096


def _labelled(rows: pa.RecordBatch, cache: dict) -> tuple[Lines, np.ndarray]:
    lines = Lines(rows.column("text").to_pylist(), cache)
    return lines, gold_tags(lines, [[(s["start"], s["end"], s["type"]) for s in own] for own in rows.column("gold").to_pylist()])


def _unread(batches: Iterator[pa.RecordBatch], read: dict[int, int], going, shards: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(part, up to ``NOTES`` rows) behind the rows of a part that were read, if its shard still learns."""
    skip = None
    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
            if part % shards not in going:
                return
            skip = read.get(part, 0) if skip is None else skip
            for at in range(min(skip, batch.num_rows), batch.num_rows, NOTES):
                yield part, batch.slice(at, min(NOTES, batch.num_rows - at))
            skip = max(skip - batch.num_rows, 0)


def _heads(read: dict[int, int], going: set[int], shards: int, most: int):
    """The next rows of each part of the shards that still learn: those that its shard takes next are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = most
        for part, rows in _unread(batches, read, going, shards):
            yield rows.slice(0, left)
            left -= min(left, rows.num_rows)
            if not left:
                return

    return run


def _learning(learners: dict[int, _Learner], read: dict[int, int], shards: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, cache, shard, upto = most, {}, None, {}
        for part, rows in _unread(batches, {}, learners, shards):
            if shard is None:
                shard = part % shards
                learner, upto = learners[shard], {p: n for p, n in read.items() if p % shards == shard}
            rows = rows.slice(0, left)
            left -= rows.num_rows
            learner.learn(*_labelled(rows, cache))
            for p in rows.column("part").to_pylist():
                upto[p] = upto.get(p, 0) + 1
            if not left:
                break
        if shard is not None:
            yield learner.rows(shard, upto)

    return run


class _Seen:
    """Labelled lines that were found right: by the same weights they are right again."""

    MOST = 1 << 17

    def __init__(self):
        self._tagged: dict[tuple, int] = {}  # whether it has tokens, by line and labels
        self._again = 0

    def new(self, rows: pa.RecordBatch) -> list[tuple[str, list]]:
        """Lines of the notes that were not seen before, with their labels; notes with a label beyond a line's end as a whole."""
        out, self._again = [], 0
        if len(self._tagged) > self.MOST:
            self._tagged.clear()
        for text, gold in zip(rows.column("text").to_pylist(), rows.column("gold").to_pylist(), strict=True):
            labels = [(s["start"], s["end"], s["type"]) for s in gold]
            if any(a is None or b is None or a < 0 or b < a or "\n" in text[a:b] for a, b, _ in labels):
                out.append((text, labels))
                continue
            at = 0
            for line in text.split("\n"):
                end = at + len(line)
                own = [(a - at, b - at, kind) for a, b, kind in labels if a < end and at < b]
                if (has := self._tagged.get((line, *own))) is None:
                    out.append((line, own))
                else:
                    self._again += has
                at = end + 1
        return out

    def count(self, new: list[tuple[str, list]], lines: Lines) -> int:
        """Lines with tokens among the notes last asked for, which were all right."""
        has = np.bincount(lines.of, minlength=len(new)).tolist()
        self._tagged.update(((text, *own), n) for (text, own), n in zip(new, has, strict=True) if n < 2 and "\n" not in text)
        return self._again + len(lines.of)


def _checking(learners: dict[int, _Learner], read: dict[int, int], shards: int):
    """The shard and number of lines that are left of a part, or -1 for the number if one of them is wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen, shard, n = {}, _Seen(), None, 0
        for part, rows in _unread(batches, read, learners, shards):
            shard = part % shards
            new = seen.new(rows)
            lines = Lines([text for text, _ in new], cache)
            if learners[shard].any_wrong(lines, gold_tags(lines, [own for _, own in new])):
                n = -1
                break
            n += seen.count(new, lines)
        if shard is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64())], names=["shard", "lines"])

    return run


def _epoch(rows: DataFrame, model: Tagger, shards: int, parts: int, learnt: bool) -> dict[int, _Learner]:
    """What each shard has learnt from its notes in their order, beginning with the model.

    One task of a shard learns from its next notes; then all tasks look through what is left of it by the weights as they are. If no line
    is wrong, learning from them would change nothing, and the shard is done, with the weights of going line by line; else it goes on.
    """
    done, going, read, most = {}, {s: _Learner(model) for s in range(shards)}, {}, ROUND
    while going:
        if learnt:  # a model that has learnt may be right everywhere
            checked = rows.mapInArrow(_checking(going, read, shards), "shard int, lines long").groupBy("shard").agg(F.min("lines").alias("least"), F.sum("lines").alias("lines"))
            left = {row.shard: row for row in checked.collect()}
            for shard in list(going):
                if shard not in left or left[shard].least >= 0:
                    done[shard] = going.pop(shard)
                    done[shard].steps += left[shard].lines if shard in left else 0
        learnt = True
        if not going:
            break
        heads = rows.mapInArrow(_heads(read, set(going), shards, most), rows.schema)
        heads = heads.repartitionById(shards, F.col("part") % shards).sortWithinPartitions("note_id", "text", "gold")
        told = heads.mapInArrow(_learning(going, read, shards, most), "shard int, kind int, key long, numbers array<double>")
        found = told.limit(shards * (FEATURES + 2) + parts).toArrow()
        _refuse_large(found.filter(pc.equal(found.column("kind"), _WEIGHT)).column("key").to_numpy())
        for shard in list(going):
            own = found.filter(pc.equal(found.column("shard"), shard))
            if own.num_rows:
                going[shard], upto = _Learner.of(model, own)
                read |= upto
        most *= 4
    return done


def _refuse_large(keys: np.ndarray) -> None:
    if len(np.unique(keys)) > FEATURES:
        raise ValueError(f"a model of more than {FEATURES} features")


_GOLD = "array<struct<start:int,end:int,type:string>>"


def train(notes: DataFrame, epochs: int = 5, shards: int = 4, id_col: str = "note_id", text_col: str = "text", gold_col: str = "gold") -> Tagger:
    """A model from notes with labelled spans. Null texts and notes without an id are left out; no notes give a model that tags nothing."""
    gold = F.transform(gold_col, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["type"].alias("type")))
    gold = F.coalesce(gold, F.array().cast(_GOLD))
    rows = notes.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("note_id"), F.col(text_col).alias("text"), gold.alias("gold"))
    # notes are dealt by a hash; a shard is every shards-th part, so it has the same notes whatever the number of parts, and all cores have some of them
    parts = shards * -(-4 * notes.sparkSession.sparkContext.defaultParallelism // shards)
    rows = rows.withColumn("part", F.pmod(F.hash("note_id"), F.lit(parts)))
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("note_id", "text", "gold").persist(StorageLevel.MEMORY_AND_DISK)
    model = Tagger(np.zeros(0, np.uint64), np.zeros((1, N)), np.zeros((N + 1, N)))
    total: dict[int, np.ndarray] = {}
    weights: dict[int, np.ndarray] = {}
    try:
        for epoch in range(epochs):
            learners = _epoch(rows, model, shards, parts, epoch > 0)
            summed: dict[int, np.ndarray] = {}
            for _, learner in sorted(learners.items()):
                for key, change in learner.changes():
                    summed[key] = summed.get(key, np.zeros(2 * N)) + change
            before = {k: w.copy() for k, w in weights.items()}
            means = {}
            for key, change in summed.items():
                change = change / shards
                means[key] = change[N:]
                weights[key] = weights.get(key, np.zeros(N)) + change[:N]
            _refuse_large(np.array([*summed]))
            for key in weights:
                total[key] = total.get(key, np.zeros(N)) + before.get(key, np.zeros(N)) + means.get(key, np.zeros(N))
            model = _model(weights)
            if not any(learner.wrong for learner in learners.values()):
                for key in weights:  # all that is left would begin with these weights and change none
                    for _ in range(epoch + 1, epochs):
                        total[key] = total[key] + weights[key]
                break
    finally:
        rows.unpersist()
    return _model({k: v / epochs for k, v in total.items()})


def _model(weights: dict[int, np.ndarray]) -> Tagger:
    moves = np.array([weights.get(i, np.zeros(N)) for i in range(N + 1)])
    keys = np.array([k for k in weights if not 0 <= k <= N], np.int64).astype(np.uint64)
    order = np.argsort(keys)
    rows = np.array([weights[k] for k in keys[order].astype(np.int64).tolist()]).reshape(-1, N)
    return Tagger(keys[order], np.concatenate((rows, np.zeros((1, N)))), moves)


def save(spark: SparkSession, model: Tagger, path: str) -> None:
    """The weights as Parquet, a row for each feature and each row of moves."""
    rows = [(int(k), w.tolist()) for k, w in zip(model.keys.astype(np.int64), model.weights[:-1], strict=True)] + [(i, m.tolist()) for i, m in enumerate(model.moves)]
    spark.createDataFrame(rows, "key long, weights array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Tagger:
    rows = spark.read.schema("key long, weights array<double>").parquet(path).limit(FEATURES + N + 2).collect()
    if len(rows) > FEATURES + N + 1:
        raise ValueError(f"a model of more than {FEATURES} features")
    return _model({r.key: np.array(r.weights) for r in rows})


def tagged(notes: DataFrame, model: Tagger, column: str = "ner_spans", text_col: str = "text") -> DataFrame:
    """Add the model's spans, for ``detect(..., ner_col=column)``. The model is broadcast; its size is bounded by ``FEATURES``."""
    from lacuna.operators.ner import model_spans

    sent = notes.sparkSession.sparkContext.broadcast(model)
    return model_spans(notes, lambda texts: sent.value.detect(texts), column, text_col)
