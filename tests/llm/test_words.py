import numpy as np
import pyarrow as pa
import pytest

from lacuna.llm import kn_lm
from lacuna.llm import wordblock as wb
from lacuna.llm.fm_index import FMIndex, window_matches
from tests.llm.texts import WORD, corpus, words


@pytest.mark.parametrize("limit", [1, 200, 1 << 20])
def test_words_and_hashes(limit):
    rows = corpus() + [(900, " a"), (901, "b "), (902, "c"), (903, "\t"), (904, "d\x0be")]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    of_hash, seen = {}, 0
    for block in wb.blocks(iter([batch.slice(0, 40), batch.slice(40)]), limit=limit):
        w = block.words(lower=True)
        h = w.hashes()
        for d, i in enumerate(block.column("doc_id").tolist()):
            text = dict(rows)[i]
            a, b = w.first[d], w.first[d + 1]
            got = [w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])]
            assert got == words(text)
            for x, y in zip(got, h[a:b].tolist()):
                assert of_hash.setdefault(x, y) == y
            seen += 1
    assert seen == len(rows) and len(set(of_hash.values())) == len(of_hash)
    assert WORD.findall("d\x0be") == ["d", "e"]


def test_shingles_tell_sequences_apart():
    h = wb.mix(np.arange(6, dtype=np.uint64))
    s = wb.shingles(h, 5)
    assert len(s) == 2 and s[0] != s[1] and len(wb.shingles(h[:3], 5)) == 0
    assert wb.shingles(h[::-1].copy(), 5)[0] != s[1]


def test_crafted_long_words_differ():
    """Thue-Morse words and their complements, on which polynomial hashes modulo 2**64 agree."""
    from lacuna.llm.wordblock import blocks

    texts = []
    for k in range(3, 17):
        bits = [i.bit_count() & 1 for i in range(1 << k)]
        texts.append("".join("ab"[b] for b in bits) + " " + "".join("ba"[b] for b in bits))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    seen = [x for block in blocks(iter([batch])) for x in block.words(lower=False).hashes().tolist()]
    assert len(set(seen)) == 2 * len(texts)


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics_find_all_windows(seed):
    rng = np.random.default_rng(seed)
    window, sigma = int(rng.integers(1, 8)), int(rng.integers(2, 6))
    texts = lambda n, most: np.concatenate([[0], *(np.append(rng.integers(1, most, rng.integers(1, 15)), 0) for _ in range(n))])
    known, asked = texts(6, sigma), texts(8, sigma + 2)
    cut = np.flatnonzero(asked == 0)
    index = FMIndex(known, window)
    got = window_matches(index, asked, cut[:-1] + 1, cut[1:])
    have = {tuple(known[i : i + window]) for i in range(len(known) - window + 1)}
    for a, b in zip(cut[:-1] + 1, cut[1:]):
        for k in range(a, b):
            assert got[k] == (k + window <= b and tuple(asked[k : k + window]) in have)
    lo, hi = index.all(sigma - 1)
    a, b = index.extend(lo, hi, np.arange(1, sigma))
    assert (b - a).tolist() == [int((known == k).sum()) for k in range(1, sigma)]


def test_windows_longer_than_the_depth_are_refused():
    with pytest.raises(ValueError):
        FMIndex(np.array([0, 1, 0]), 32)


def _unmix(x: int) -> int:
    """The inverse of ``mix``."""
    mask = (1 << 64) - 1
    x ^= x >> 31 ^ x >> 62
    x = x * pow(0x94D049BB133111EB, -1, 1 << 64) & mask
    x ^= x >> 27 ^ x >> 54
    x = x * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) & mask
    return x ^ x >> 30 ^ x >> 60


def crafted(word: bytes, key: int = 0, tries: int = 400_000) -> bytes:
    """Another printable word of 16 bytes with the same hash under ``key``: the first eight bytes freely, the last ones solved for."""
    one = lambda x: int(wb.mix(np.array([x], np.uint64))[0])
    start = one(16 * 0x8CB92BA72F3D8DD7 % (1 << 64) ^ key)
    whole = lambda b: one(one(start ^ int.from_bytes(b[:8], "little")) ^ int.from_bytes(b[8:], "little"))
    before = _unmix(whole(word))
    rng = np.random.default_rng(1)
    first = rng.integers(97, 123, (tries, 8), dtype=np.uint8)
    last = wb.mix(np.uint64(start) ^ first.view("<u8").ravel()) ^ np.uint64(before)
    fits = ((last.view(np.uint8).reshape(-1, 8) - 0x21) < 0x5E).all(axis=1)
    k = int(np.flatnonzero(fits)[0])
    return first[k].tobytes() + last[k : k + 1].tobytes()


def test_words_solved_for_share_a_hash_only_without_the_secret():
    word = b"harmlesspassages"
    other = crafted(word)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [f"{word.decode()} {other.decode()}"]})
    words = next(wb.blocks(iter([batch]))).words(lower=False)
    a, b = words.hashes().tolist()
    assert a == b and other != word
    a, b = words.hashes(wb.KEY).tolist()
    assert a != b


def test_solved_words_are_told_apart_by_joins_and_dedup(spark):
    from lacuna.llm import fm_dedup, ngram_join
    from tests.llm.texts import frame, similar, stripped

    word = "harmlesspassages"
    other = crafted(word.encode()).decode()
    rows = [(0, " ".join([word] * 25)), (1, " ".join([other] * 25)), (2, " ".join([other.lower()] * 25))]
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(frame(spark, rows)).collect()}
    assert linked == similar(rows) and linked[0][1] != linked[1][1]
    left = {r.doc_id: r.n_removed for r in fm_dedup.strip_repeats(frame(spark, rows)).collect()}
    assert left == {i: n - len(k) for i, (n, k) in stripped(rows).items()}


def test_a_part_of_the_ranges_sorts_its_own_grams_only(monkeypatch):
    """Together the parts have the grams and counts of all ranges."""
    texts = [" ".join(f"w{(i * i + j) % 31}" for j in range(i % 9)) for i in range(200)]
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts, "held_out": [i % 7 == 2 for i in range(200)]})
    row = next(kn_lm._chunks(iter([docs]))).to_pylist()[0]
    chunk, ranges = kn_lm.Chunk.of(row), 8
    longest = chunk.grams(3)[0]
    told = [{"range": 0, "totals": kn_lm._columns(np.arange(1, len(longest) + 1).reshape(-1, 1) % 5), "owned": kn_lm.squeezed(np.packbits(np.arange(len(longest)) % 3 > 0).tobytes())}]
    sizes, distinct = [], kn_lm.distinct
    monkeypatch.setattr(kn_lm, "distinct", lambda h, *a: sizes.append(len(h)) or distinct(h, *a))
    asked = lambda part, parts: [r for b in kn_lm._ask(2, 3, ranges, part, parts)(iter([pa.RecordBatch.from_pylist([row | {"told": told}])])) for r in b.to_pylist()]
    whole, parts = asked(0, 1), asked(0, 2) + asked(1, 2)
    assert sorted(whole, key=lambda r: r["range"]) == sorted(parts, key=lambda r: r["range"]) and len(whole) == ranges
    assert sizes[0] == len(chunk.tokens) == sizes[2] + sizes[4]


def test_grams_are_owned_by_the_first_chunk_that_trains_on_them():
    asked = [{"chunk": c, "range": 0, "keys": kn_lm.squeezed(kn_lm.spaced(np.array(k, np.uint64))), "counts": kn_lm._columns(np.array(n).reshape(-1, 1))} for c, k, n in ((5, [1, 2, 9], [3, 0, 0]), (2, [1, 2], [0, 4]), (7, [1, 2, 9], [1, 1, 0]))]
    out = [r for r in kn_lm._merge(1)(pa.Table.from_pylist(asked)).to_pylist() if r["chunk"] >= 0]
    got = {r["chunk"]: (kn_lm._from_columns(r["totals"], 1).ravel().tolist(), np.unpackbits(np.frombuffer(kn_lm.restored(r["owned"]), np.uint8)).tolist()) for r in out}
    assert {c: (t, o[: len(t)]) for c, (t, o) in got.items()} == {2: ([4, 5], [0, 1]), 5: ([4, 5, 0], [1, 0, 0]), 7: ([4, 5, 0], [0, 0, 0])}
