"""Operators against brute force, exact round trips and held-out accuracy; with nulls, empties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lacuna.llm import decontam, fm_dedup, graph, kn_lm, license_scan, media_jpeg, ngram_join, packing, quality_zstd, toxic_segments, url_rules
from tests.llm.texts import corpus, frame, held, similar, stripped, words

ROWS = corpus()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def thue_morse(k):
    bits = [i.bit_count() & 1 for i in range(1 << k)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


# 1


def test_jpeg_round_trip(spark):
    rows = [*ROWS, (500, "\x00\xff é" * 3000), (501, "z" * 1_600_000)]
    got = by_id(media_jpeg.media_columns(frame(spark, rows)))
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
    assert got[501].frames == 2 and got[500].width == 1536
    assert media_jpeg.media_columns(frame(spark, [])).count() == 0


def test_jpeg_of_any_bytes_and_with_ac_coefficients():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 192 * 50, dtype=np.uint8)
    assert b"".join(t.tobytes() for t in media_jpeg.thumbnails(media_jpeg.encode([raw]))[0]) == raw.tobytes()
    # two blocks with AC coefficients behind the DC: codes by canonical(), bits written one by one
    dc = media_jpeg.canonical({0: 2, 3: 2, 4: 2})
    ac = media_jpeg.canonical({0x00: 2, 0x01: 2, 0xF0: 3, 0x12: 3})
    bits = ""
    put = lambda code, n: format(code, f"0{n}b")
    for size, low, tail in ((4, 0b1010, (0x01, 0xF0, 0x12, 0x00)), (3, 0b011, (0x12, 0x00))):
        bits += put(*dc[2][size]) + put(low, size)
        for s in tail:
            bits += put(*ac[2][s]) + "1" * (s & 15)
    bits += "1" * (-len(bits) % 8)
    scan = b"".join(bytes([b]) + b"\0" * (b == 255) for b in int(bits, 2).to_bytes(len(bits) // 8, "big"))
    head = media_jpeg._header(1)
    table = lambda k, t: media_jpeg._segment(0xC4, bytes([k]) + bytes(t[0]) + bytes(t[1]))
    sof = media_jpeg._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    data = b"\xff\xd8" + head[head.index(b"\xff\xdb") : head.index(b"\xff\xc0")] + sof + table(0, dc) + table(16, ac) + media_jpeg._segment(0xDA, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9"
    thumb = media_jpeg.thumbnails([data])[0][0]
    assert thumb.tolist() == [[128 + 10, 128 + 10 - 4]]
    with pytest.raises(ValueError):
        media_jpeg.thumbnails([data[:20]])


# 2


def test_pairs_of_alike_documents_meet_once(spark):
    """Two groups share many lists: a pair is not made anew in each of them, and none is lost."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = lambda keep, k: " ".join(base[:keep] + [f"x{k}_{i}" for i in range(400 - keep)])
    texts = {k: near(370, k) for k in range(8)}
    hashed = {k: np.array([hash(tuple(t.split()[i : i + 5])) for i in range(396)]) for k, t in texts.items()}
    rows = [(int(v), k, 396, i, k) for k, values in hashed.items() for i, v in enumerate(values[:80])]
    hits = spark.createDataFrame(rows, "key long, doc_id long, n long, place int, part long")
    bits = frame(spark, list(texts.items())).select("doc_id", "text").mapInArrow(ngram_join._bitmaps(5), "doc_id long, n long, bits binary, " + ", ".join(f"{c} long" for c in ngram_join._small()))
    lists = ngram_join._listed(hits, bits)
    assert lists.count() == 8  # the 80 lists have the same members
    # each of the first two lists lacks another document, so they are told apart
    less = hits.where("NOT (place = 0 AND doc_id = 7) AND NOT (place = 1 AND doc_id = 6)")
    got = [tuple(r) for r in ngram_join._pairs(ngram_join._listed(less, bits)).collect()]
    assert sorted(got) == [(i, j) for i in range(8) for j in range(i + 1, 8)]


def test_similar_components(spark):
    rows = [*ROWS, (600, "one two three"), (601, "One TWO three"), (602, "one two"), (603, "a b c d e f g h i j"), (604, "a b c d e f g h i j k")]
    got = by_id(ngram_join.similar_components(frame(spark, rows)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == similar(rows)
    assert ngram_join.similar_components(frame(spark, [])).count() == 0
    twice = ngram_join.similar_components(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]))
    assert sorted((r.doc_id, r.component_id) for r in twice.collect()) == [(1, 1), (1, 1), (2, 2)]


def test_repeated_ids_do_not_multiply(spark):
    """One id many times, in two documents that link and in one with several texts."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 200 + [(2, text + " more")] * 200 + [(3, f"{text} {i}" if i % 2 else "else") for i in range(200)]
    got = ngram_join.similar_components(frame(spark, rows)).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    kept = {(r.doc_id, r.component_id, r["count"]) for r in got}
    assert {(1, 1, 200), (2, 1, 200)} < kept and kept - {(1, 1, 200), (2, 1, 200)} in ({(3, 1, 200)}, {(3, 3, 200)})


def test_words_and_sizes_that_could_collide(spark):
    """Crafted words, a very long text, and sets whose similarity is exactly the threshold."""
    one, two = thue_morse(11)
    nine = "a b c d e f g h i j k l m".split()  # 9 shingles; 8 of them shared by texts one word longer at an end
    long = [f"l{i}" for i in range(40_000)]
    rows = [(1, f"{one} x y z q"), (2, f"{two} x y z q"), (3, " ".join(nine)), (4, " ".join(["z", *nine[:-1]])), (5, " ".join(long)), (6, " ".join(long[400:])), (7, " ".join(long[:20_000]))]
    got = by_id(ngram_join.similar_components(frame(spark, rows)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == similar(rows)
    assert got[3].component_id == got[4].component_id == 3 and got[6].component_id == 5 and got[2].component_id == 2


def test_links_not_found_by_pivots_are_enumerated(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    got = by_id(ngram_join.similar_components(frame(spark, ROWS)))
    assert {i: r.component_id for i, r in got.items()} == {i: c for i, (_, c) in similar(ROWS).items()}


def test_boundary_grows_with_list_length():
    assert ngram_join.choose_boundary(1) <= ngram_join.choose_boundary(5) <= ngram_join.choose_boundary(50)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100 + i, 100 + rng.randrange(max(i, 1))) for i in range(40)] + [(7, 7), (1, 0)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(40)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3 and 10


def labelled(spark, bad, column, n=400):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        y = i % 4 != 0 if column == "quality" else int(i % 4 == 0)
        rows.append((i, bad(rng, w) if i % 4 == 0 else " ".join(w)))
        labels.append((i, int(y)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 50_000)]
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (9999, None)], f"doc_id long, {column} int"), dict(labels)


@pytest.mark.parametrize(("module", "column", "bad"), [
    (quality_zstd, "quality", lambda rng, w: " ".join(x.upper() + "!!" for x in w)),
    (toxic_segments, "toxic", lambda rng, w: " ".join(w[:10] + [rng.choice(["vile", "rotten"]) for _ in range(3)] + w[10:])),
])
def test_classifiers(spark, module, column, bad):
    docs, labels, want = labelled(spark, bad, column)
    got = by_id(module.score(docs, labels))
    assert set(got) == set(want) | {400, 401, 402}
    out = [got[i].predicted == y for i, y in want.items() if held(i, 3, 1)]
    assert np.mean(out) > 0.95
    for r in got.values():
        assert 0 <= r.score <= 1 and r.held_out == held(r.doc_id, 3, 1)
    none = module.score(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert module.score(docs.limit(0), labels).count() == 0


def test_quality_learns_from_whole_texts(spark):
    rng = random.Random(4)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n)]
    vocabulary = fresh(300)
    some = lambda: " ".join(rng.choice(vocabulary) for _ in range(2200))
    rows = [(i, some() + " " + (some().upper() if i % 2 else some())) for i in range(120)]
    assert min(len(t) for _, t in rows) > 2 * 8192
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    got = by_id(quality_zstd.score(frame(spark, rows), labels))
    out = [got[i].predicted == 1 - i % 2 for i, _ in rows if held(i, 3, 1)]
    assert len(out) > 20 and np.mean(out) > 0.95


def test_samples_are_bounded(spark, monkeypatch):
    """One id many times is one row to learn from; texts are learnt from whole or measured whole."""
    from lacuna.llm.labelled import training

    rows = [(0, "same text")] * 3000 + [(0, "other text")] * 3 + [(i, f"text {i} " * 5) for i in range(3, 60, 3)] + [(1, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 0)], "doc_id long, quality int")
    docs = frame(spark, rows).selectExpr("doc_id", "coalesce(text, '') AS text")
    known, totals = training(docs, labels, "quality", 8)
    assert known.groupBy("doc_id").count().where("count > 1").isEmpty() and known.groupBy("label").count().where("count > 8").isEmpty()
    assert totals == {k: sum(1 for i in range(60) if i % 2 == k and not held(i, 3, 1)) for k in (0, 1)}
    text = bytes(range(97, 123)) * 8000
    some = spark.createDataFrame([(5, text.decode(), 1), (6, "z" * 5000, 0)], "doc_id long, text string, label int")
    kept = some.mapInArrow(quality_zstd._pieces, "label int, doc_id long, place long, piece binary").collect()
    for label, want in ((0, b"z" * 5000), (1, text)):
        assert b"".join(bytes(r.piece) for r in sorted(kept, key=lambda r: r.place) if r.label == label) == want
    assert quality_zstd._fitting([3, 9, 4, 2, 1], 8) == [True, False, True, False, True]
    monkeypatch.setattr(quality_zstd, "SAMPLE_BYTES", 4000)
    docs, labels, want = labelled(spark, lambda rng, w: " ".join(x.upper() + "!!" for x in w), "quality")
    got = by_id(quality_zstd.score(docs, labels))
    assert np.mean([got[i].predicted == y for i, y in want.items() if held(i, 3, 1)]) > 0.9


def test_keep_good_keeps_columns(spark):
    docs, labels, want = labelled(spark, lambda rng, w: " ".join(x.upper() + "!!" for x in w), "quality")
    kept = quality_zstd.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i, y in want.items() if y and i not in ids]) <= 3 and len([i for i, y in want.items() if not y and i in ids]) <= 3


def test_maximal_segments_against_definition():
    """Recursive definition: the best segment, then those left and right of it."""
    rng = random.Random(2)

    def best(x, lo, hi):
        top = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if top is None or top[0] <= 0:
            return []
        _, _, _, a, b = top
        return [*best(x, lo, a), (a, b - 1), *best(x, b, hi)]

    for _ in range(200):
        x = [rng.choice([-1.25, -1.25, -1.25, 1 + rng.random(), 3 * rng.random()]) for _ in range(rng.randrange(1, 14))]
        at = [i for i, v in enumerate(x) if v > 0]
        got = toxic_segments.maximal_segments(at, [x[i] for i in at], -1.25)
        assert [(a, b) for a, b, _ in got] == best(x, 0, len(x))
        assert all(abs(s - sum(x[a : b + 1])) < 1e-9 for a, b, s in got)


def test_scan_of_segments_is_linear():
    import time

    def took(n):
        rng = random.Random(n)
        at = sorted(rng.sample(range(3 * n), n))
        scores = [0.1 + rng.random() for _ in at]
        best = math.inf
        for _ in range(3):
            began = time.perf_counter()
            for rest in (-0.01, -0.4, -5.0):
                toxic_segments.maximal_segments(at, scores, rest)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(64_000) < 16 * took(8_000)  # 8 where linear, 64 where quadratic


def test_extreme_value_parameters_are_found():
    rng = np.random.default_rng(1)
    m = rng.integers(20, 2000, 4000)
    best = np.maximum((np.log(0.02 * m) - np.log(-np.log(rng.random(4000)))) / 0.7, 0)
    lam, k = toxic_segments.extreme_value(m, best)
    assert abs(lam - 0.7) < 0.05 and abs(k - 0.02) < 0.004
    assert toxic_segments.extreme_value(m[:5], best[:5]) == (1.0, 1.0)


def test_scores_against_plain_versions(spark):
    """The registered scores, recomputed from the fitted models by plain Python."""
    import zstandard as z

    docs, labels, want = labelled(spark, lambda rng, w: " ".join(w[:10] + [rng.choice(["vile", "rotten"]) for _ in range(3)] + w[10:]), "toxic")
    both = labels.withColumnRenamed("toxic", "quality").selectExpr("doc_id", "1 - quality AS quality", "quality AS toxic")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality_zstd.fit(docs.selectExpr("doc_id", "coalesce(text, '') AS text"), both)
    size = lambda raw, t: sum(len(z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False).compress(t[i : i + 1024])) for i in range(0, len(t), 1024))
    for i, r in by_id(quality_zstd.score(docs, both)).items():
        raw = texts[i].encode()
        d = (size(model.bad, raw) - size(model.good, raw)) / max(len(raw), 1)
        assert r.difference == pytest.approx(d) and r.score == pytest.approx(1 / (1 + math.exp(-(d * model.beta[0] + model.beta[1]))))
    toxic = toxic_segments.fit(docs.selectExpr("doc_id", "coalesce(text, '') AS text"), both)
    from lacuna.llm.wordblock import blocks
    import pyarrow as pa

    vocabulary = sorted({w for t in texts.values() for w in t.split()})
    batch = pa.RecordBatch.from_pydict({"doc_id": [0], "text": [" ".join(vocabulary)]})
    of = dict(zip(vocabulary, next(blocks(iter([batch]))).words(lower=True, alnum=True).hashes().tolist()))
    score = dict(zip(toxic.tokens.tolist(), toxic.scores.tolist()))
    assert {w for w in vocabulary if of[w] in score} >= {"vile", "rotten"} and toxic.lam > 0

    def parts(x, lo, hi):
        sums = [0.0]
        for v in x[lo:hi]:
            sums.append(sums[-1] + v)
        low, best = 0, (0.0, 0, 0)
        for j in range(1, len(sums)):
            if sums[j] - sums[low] > best[0]:
                best = (sums[j] - sums[low], low, j)
            if sums[j] <= sums[low]:
                low = j
        s, a, b = best
        return [] if s <= 0 else [*parts(x, lo, lo + a), (lo + a, lo + b - 1, s), *parts(x, lo + b, hi)]

    for i, r in by_id(toxic_segments.score(docs, both)).items():
        x = [score.get(of[w], toxic.rest) for w in texts[i].split()]
        found = parts(x, 0, len(x))
        e = toxic_segments.FLOOR
        if x:
            e = math.log(sum(math.exp(toxic.lam * s) for *_, s in found) or 1) - math.log(toxic.k * len(x))
        e = min(max(e, toxic_segments.FLOOR), toxic_segments.CEILING)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(e * toxic.beta[0] + toxic.beta[1])))), i
        assert [(p.first, p.last) for p in r.passages] == [(a, b) for a, b, s in found if toxic.k * len(x) * math.exp(-toxic.lam * s) < 0.01]


# 4


def test_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(kn_lm, "CHUNK_BYTES", 5000)
    got = by_id(kn_lm.score(frame(spark, ROWS)))
    tokens = {i: [*words(t), "</s>"] for i, t in ROWS}
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, w in tokens.items():
        if not held(i, 7, 2):
            uni.update(w)
            for a, b in zip(["<s>", *w], w):
                bi[a, b] += 1
                ctx[a] += 1
    n, v = sum(uni.values()), len(uni)
    d = kn_lm.discounts(*(Counter(bi.values())[k] for k in (1, 2, 3, 4)))
    before, after = Counter(b for _, b in bi), defaultdict(lambda: [0, 0, 0])
    for (a, _), c in bi.items():
        after[a][min(c, 3) - 1] += 1
    cc = Counter(before.values())
    dw = kn_lm.discounts(*(cc[k] for k in (1, 2, 3, 4)))
    rest = (dw[0] * cc[1] + dw[1] * cc[2] + dw[2] * sum(x for k, x in cc.items() if k > 2)) / len(bi)

    def p(a, b):
        low = (before[b] - (dw[min(before[b], 3) - 1] if before[b] else 0)) / len(bi) + rest / (v + 1)
        if not ctx[a]:
            return low
        c = bi[a, b]
        return (c - (d[min(c, 3) - 1] if c else 0)) / ctx[a] + sum(x * y for x, y in zip(d, after[a])) / ctx[a] * low

    for context in ("<s>", "the", "unseen"):
        assert abs(sum(p(context, w) for w in uni) + p(context, "never seen") - 1) < 1e-9
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 7, 2), len(w), sum(x in uni for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w)))
    assert kn_lm.score(frame(spark, [])).count() == 0
    a, b = [i for i in range(99) if not held(i, 7, 2)][:2]
    only = next(i for i in range(99) if held(i, 7, 2))
    twice = kn_lm.score(frame(spark, [(a, "a b"), (a, "a b"), (b, " ".join(f"l{i}" for i in range(50_000))), (None, "a")]))
    assert sorted((r.doc_id, r.n_tokens, r.train_tokens) for r in twice.collect()) == [(a, 3, 50_007), (a, 3, 50_007), (b, 50_001, 50_007)]
    crafted = by_id(kn_lm.score(frame(spark, list(zip((a, only), thue_morse(12), strict=True)))))
    assert (crafted[a].n_known, crafted[only].n_known) == (2, 1)
    assert kn_lm.score(frame(spark, [(only, "a b")])).first().score == 0


@pytest.mark.parametrize("order", (3, 4))
def test_kneser_ney_of_higher_order(spark, monkeypatch, order):
    monkeypatch.setattr(kn_lm, "CHUNK_BYTES", 5000)
    got = by_id(kn_lm.score(frame(spark, ROWS), order=order))
    tokens = {i: ["<s>", *words(t), "</s>"] for i, t in ROWS}
    grams = lambda w, k: [tuple(w[j - k + 1 : j + 1]) for j in range(max(1, k - 1), len(w))]
    raw = {k: Counter(g for i, w in tokens.items() if not held(i, 7, 2) for g in grams(w, k)) for k in range(1, order + 1)}
    c = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in raw[k + 1]) + Counter({g: n for g, n in raw[k].items() if g[0] == "<s>"})
    v, d, after = len(raw[1]), {}, defaultdict(lambda: [0, 0, 0, 0])
    for k in c:
        d[k] = kn_lm.discounts(*(Counter(c[k].values())[n] for n in (1, 2, 3, 4)))
        for g, n in c[k].items():
            after[g[:-1]][min(n, 3) - 1] += 1
            after[g[:-1]][3] += n

    def p(g):
        k, low = len(g), 1 / (v + 1) if len(g) == 1 else p(g[1:])
        *kinds, total = after[g[:-1]]
        if not total:
            return low
        n = c[k][g]
        return (n - (d[k][min(n, 3) - 1] if n else 0)) / total + sum(x * y for x, y in zip(d[k], kinds)) / total * low

    some = next(g[:-1] for g in c[order])
    for context in (("<s>",), some, some[1:], ("unseen",) * (order - 1)):
        assert abs(sum(p((*context, *w)) for w in raw[1]) + p((*context, "never seen")) - 1) < 1e-9
    for i, w in tokens.items():
        assert got[i].score == pytest.approx(sum(math.log10(p(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(1, len(w))))
    assert kn_lm.score(frame(spark, []), order=order).count() == 0
    with pytest.raises(ValueError):
        kn_lm.score(frame(spark, ROWS), order=1)


def test_packed_counts():
    x = np.array([0, 1, 254, 255, 256, 70000, 3])
    assert kn_lm.unpacked(kn_lm.packed(x)).tolist() == x.tolist() and kn_lm.unpacked(kn_lm.packed(x[:0])).tolist() == []


def test_distinct_hashes():
    """As numpy's, with hashes that differ in their lowest bits alone too."""
    rng = np.random.default_rng(0)
    near = (rng.integers(0, 4, 3000).astype(np.uint64) << np.uint64(60)) + rng.integers(0, 9, 3000).astype(np.uint64)
    for values in (near, rng.integers(0, 1 << 63, 3000).astype(np.uint64), near[:1], near[:0], np.full(5, (1 << 64) - 1, np.uint64)):
        keys, first, place = np.unique(values, return_index=True, return_inverse=True)
        got = kn_lm.distinct(values)
        assert [x.tolist() for x in got] == [keys.tolist(), place.tolist(), first.tolist()]


# 5

TRICKY = ["it's I'LL <|endoftext|> a_b x1²3 ½", "DON'T 'S!!'s it''sß ŉ \x00", "Σας ſ İ µ", "á é \x85\x1c", "naïve—“q”", "ĐĦ Œuvre"]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    exact = Tokenizer.from_file(path)
    rows = [*ROWS, *((700 + i, t) for i, t in enumerate(TRICKY)), (800, "long words " * 3000)]
    got = packing.pack(frame(spark, rows), path).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for i, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(docs[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        assert all(r.doc_tokens == len(ids) for r in own) and [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist() and total <= 2048
        padding += 2048 - total
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert padding <= 4 * 2048  # a few open bins of each of three tasks
    assert packing.pack(frame(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), path, capacity=0)
    twice = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")]), path).collect()
    assert sorted((r.doc_id, r.length) for r in twice) == [(1, 3), (1, 3)]


@pytest.mark.parametrize("capacity", [2048, 1000, 7])
def test_harmonic_bins(capacity):
    """A bin of a class has its number of pieces, no bin more padding than allowed, every length is dealt out in full."""
    rng = random.Random(capacity)
    bins = packing.Bins(capacity, 0)
    lengths = [rng.choice([1, 5, rng.randrange(1, 4 * capacity), rng.randrange(1, capacity + 1)]) for _ in range(5000)]
    pieces, kinds = 0, {}
    for i, n in enumerate(lengths):
        at = 0
        for k, size in bins.cut(n):
            assert size >= 1 and (not k or size * k <= capacity < size * (k + 1) + k + 1)
            kinds[i, at] = k
            bins.put(k, size, [i, at, size])
            at, pieces = at + size, pieces + 1
        assert at == n
    whole = {s for _, s, _ in bins.done}
    bins.close()
    assert len(bins.done) == pieces
    held = defaultdict(list)
    for row, s, offset in bins.done:
        held[s].append((offset, *row))
    for s, rows in held.items():
        rows.sort()
        total = sum(r[3] for r in rows)
        assert [r[0] for r in rows] == np.cumsum([0, *(r[3] for r in rows[:-1])]).tolist() and total <= capacity
        if s in whole:
            k = {kinds[r[1], r[2]] for r in rows}
            assert len(k) == 1 and (k == {0} or k == {len(rows)})
            assert capacity - total <= max(capacity // packing.SLACK, *k)
    assert sum(r[3] for rows in held.values() for r in rows) == sum(lengths)


def test_another_tokenizer_goes_through_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    exact, short = Tokenizer.from_file(path), packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    coder = packing.Ids(path)
    for text in ["Some Words, it's 12  o'clock", "plain words", *TRICKY]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids
    assert short._short and not coder._short


# 6 and 9


def test_pattern_tokens_where_urls_run_on(spark):
    urls = ["/a?utm_source=", "/a?ref=x", "/a?page=1&ref=", "/en/12.html", "://m.a.b/de/", "://blog.a.b/", "/online-casino.", "/wp-login.php", "/track/click?"]
    for p, url in zip(url_rules.PATTERNS, urls, strict=True):
        for run_on in ("", "5", "x", "/", "?q", "-y"):
            if re.search(p.regex, url + run_on):
                assert {*p.tokens} <= {*re.findall("[0-9a-z]+", url + run_on)}, (p, url + run_on)
        assert re.search(p.regex, url)
    rows = [(1, "http://a.org/wp-login.php5"), (2, "http://a.org/wp/login"), (3, "http://a.org/wp-login.php")]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i].verdict, got[i].pattern) for i in (1, 2, 3)] == [("block", "/wp-login[.]php"), ("allow", None), ("block", "/wp-login[.]php")]


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x", "http://example.com/en/x", "https://a.example.com/fr", "http://x.net/es/1?utm_source=a", "http://x.net/", "http://com", "http://com/", "nonsense", None, "", "http://m.x.org/de/5", "http://x.org/a?page=1&ref=z", "ftp://xexample.com/en/", "http://x.org/en/5.html#a", "http://h.org?utm_source=1", "http://play.casino.org/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(3, urls[3], "y")], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("a.example.com", "/fr", "com/", "allow")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block")
    assert got[4] == ("x.net", "/", None, "allow")
    assert got[5] == ("com", "", None, "allow") and got[6] == ("com", "/", "com/", "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][3] == got[11][3] == got[14][3] == got[15][3] == "block"
    assert got[12] == ("xexample.com", "/en/", "com/", "allow") and got[13][3] == "allow"
    assert url_rules.judge(df).count() == len(urls) + 1 and url_rules.judge(df.limit(0)).count() == 0


def test_many_host_rules(spark):
    rules = [(f"h{i}.org", "/", "block") for i in range(3000)] + [("org", "/a", "allow"), ("h7.org", "/a/b", "allow"), ("h7.org", "/a/b", "block")]
    urls = ["http://h2999.org/x", "http://x.h5.org/a", "http://h7.org/a/b/c", "http://other.org/a", "http://org/b", "http://h7.org.uk/", None, "http://h1.org:80/", "http://" + "a." * 2000 + "h3.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(df, host_rules=rules).collect()}
    assert got == {0: ("h2999.org/", "block"), 1: ("h5.org/", "block"), 2: ("h7.org/a/b", "allow"), 3: ("org/a", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("h3.org/", "block")}


def test_native_sql(spark, tmp_path):
    """Both native operators against DuckDB, where every rule and phrase is tried everywhere."""
    import duckdb

    texts = [*ROWS, (700, "MIT License mit license, the Apache-License."), (701, "Released under the MIT License."), (702, "licensed under the apache license version 3 0 Licensed under the Apache License, Version 2.0"), (703, "GNU General Public License, version 3"), (704, "mit  license"), (705, "éMIT License")]
    for i, x in enumerate(license_scan.TEMPLATES):  # whole, with a tenth of the words changed, with a third, cut off, one word too many
        w = x.words
        texts += [(800 + i, "Copyright 2020. " + x.text.capitalize() + "."), (900 + i, " ".join("other" if k % 10 == 7 else v for k, v in enumerate(w))), (1000 + i, " ".join("other" if k % 3 == 2 else v for k, v in enumerate(w)))]
        texts += [(1100 + i, " ".join(w[len(w) // 8 :])), (1200 + i, " ".join(w[: len(w) // 2] + ["more"] + w[len(w) // 2 :])), (1300 + i, f"{x.key} and {x.text} " * 2)]
    texts += [(1400, "the license " * 30_000 + "Released under the MIT License"), (1401, "released under the mit \u212aicense \u0130sc MIT license")]
    frame(spark, texts, extra=False).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cur = con.execute(license_scan.oracle())
    names = [d[0] for d in cur.description]
    want = sorted(str([dict(zip(names, r, strict=True))[c] for c in sorted(names)]) for r in cur.fetchall())
    got = license_scan.scan(docs, notices=False)
    assert sorted(str([r[c] for c in sorted(names)]) for r in got.collect()) == want
    rows = by_id(got)
    assert (rows[700].n_base, rows[700].first_word, rows[700].last_word, rows[700].base_labels) == (3, 0, 5, "apache,mit")
    assert rows[702].labels == "apache,apache-2.0" and rows[703].base_labels == "gpl" and rows[705].n_base == 0
    assert rows[800].labels == "apache,apache-2.0" and rows[800].score == 1.0 and rows[1400].labels == "mit"
    full = by_id(license_scan.scan(docs))
    assert [(n.label, n.first, n.share) for n in full[800].notices] == [("apache-2.0", 2, 1.0)] and full[701].notices[0].first == 0
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_licence_index_has_what_a_notice_keeps():
    """Whatever words a notice lacks, as many as it may, ``AGREE`` of its postings are left."""
    rng = random.Random(6)
    words = {w for t in license_scan.TEMPLATES for w in t.words}
    index = license_scan.postings(license_scan.TEMPLATES, {w: rng.random() for w in words})
    for i, t in enumerate(license_scan.TEMPLATES):
        places = [p for x in index.values() for k, p in x if k == i]
        assert len(places) == len(set(places)) == len(t.words) - t.least + license_scan.AGREE
        assert t.words[t.key_at : t.key_at + len(t.key.split())] == t.key.split()


def test_repeated_rows_and_rows_without_an_id_in_native_scans(spark):
    rows = [(1, "MIT License"), (1, "MIT License"), (None, "MIT License"), (2, None)]
    got = license_scan.scan(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 0)]


# 7


@pytest.mark.parametrize("hot", [256, 2, 0])
def test_strip_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(fm_dedup, "HOT", hot)
    w, v = [f"w{i}" for i in range(40)], [f"v{i}" for i in range(25)]
    long = [f"l{i % 997}x{i % 89}" for i in range(30_000)]
    one, two = thue_morse(11)
    rows = [*ROWS, (300, " ".join(long)), (301, " ".join(long[200:400] + w)), (302, " ".join(w[:20] + v)), (303, " ".join(v + w)), (304, " ".join(v[1:] + w[:-1])), (305, "p q " * 60), (306, "q p " * 30)]
    rows += [(307, " ".join([one] + v[:19])), (308, " ".join([two] + v[:19])), (309, " ".join([one] + v[:19]))]
    rows += [(310 + i, " ".join(w[: 15 + i] + [f"new{i}"] + w[15 + i :])) for i in range(12)]
    got = by_id(fm_dedup.strip_repeats(frame(spark, rows)))
    for i, (n, kept) in stripped(rows).items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_pieces_are_compared_with_earlier_ones_only():
    rng = np.random.default_rng(3)
    pieces, n = [], 7
    for value in range(40):
        for _ in range(rng.integers(1, 9)):
            pieces.append((value, int(rng.integers(0, 50)), 0, rng.integers(100 * value, 100 * value + 2, 5 + n - 1)))
    pieces.append(pieces[0])
    first = {}
    for i, (value, doc, _, w) in sorted(enumerate(pieces), key=lambda x: (x[1][0], x[1][1])):
        for k in range(n):
            first.setdefault((value, doc), len(first))
    columns = [np.array(x) for x in ([p[0] for p in pieces], [p[1] for p in pieces])]
    loc = fm_dedup._loc(np.zeros(len(pieces), np.int64), np.array([64 * i for i in range(len(pieces) - 1)] + [0]), np.full(len(pieces), n))
    found = fm_dedup.later_windows(*columns, loc, np.concatenate([p[3] for p in pieces]).astype(np.uint64), 5).reshape(len(pieces), -1)
    place = [(p[1], int(x)) for p, x in zip(pieces, loc)]
    for i, (value, _, _, w) in enumerate(pieces[:-1]):
        for k in range(n):
            earlier = any(place[j] < place[i] and p[0] == value and any((p[3][m : m + 5] == w[k : k + 5]).all() for m in range(n)) for j, p in enumerate(pieces[:-1]))
            assert found[i, k] == earlier
        assert not found[i, n:].any()
    assert not found[-1].any()


def test_earliest_windows_do_not_depend_on_order_within_a_block():
    rng = np.random.default_rng(8)
    seen = fm_dedup.Earliest(30)
    known = {}
    for _ in range(60):
        value, ids, loc = (rng.integers(0, n, 200) for n in (90, 40, 3))
        got = seen.unbeaten(value, ids, loc)
        places = list(zip(value.tolist(), ids.tolist(), loc.tolist()))
        for kept, (v, *place) in zip(got.tolist(), places):
            least = min(p[1:] for p in places if p[0] == v)
            if tuple(place) != least or not kept:  # what is held back has an earlier place, here or before
                assert not kept and min(least, known.get(v, least)) < tuple(place)
        for v, *place in places:
            known[v] = min(tuple(place), known.get(v, tuple(place)))
        assert len(seen.young) <= 30 and len(seen.old) <= 30
    # ids falling within a block: one place of each window goes out
    value, ids = np.tile(np.arange(50), 1000), np.repeat(np.arange(1000)[::-1], 50)
    for order in (np.arange(50_000), rng.permutation(50_000)):
        out = fm_dedup.Earliest(100).unbeaten(value[order], ids[order], np.zeros(50_000, np.int64))
        assert out.sum() == 50 and not ids[order][out].any()
    assert len(seen.unbeaten(*[np.zeros(0, np.int64)] * 3)) == 0


def test_one_passage_in_half_of_many_documents(spark):
    """The passage is one class for each of its pieces: what reaches a shard does not grow with its copies."""
    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}"] * 3 + (w if i % 2 else [f"b{i}x{k}" for k in range(60)]))) for i in range(5000)]
    got = by_id(fm_dedup.strip_repeats(frame(spark, rows)))
    assert {i for i, r in got.items() if r.n_removed == 60} == {i for i in range(3, 5000, 2)}
    assert got[1].n_removed == 0 and all(got[i].n_removed == 0 for i in range(0, 5000, 2))


def test_rewrite_keeps_columns_and_rows(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, f"{a}  {b}"), (2, f"x {a} y"), (3, a), (3, a), (None, b), (4, None), (5, "")]
    df = frame(spark, rows)
    out = fm_dedup.rewrite(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, b), (1, f"{a}  {b}"), (2, "x y"), (3, ""), (3, ""), (4, ""), (5, "")])
    assert fm_dedup.strip_repeats(frame(spark, [])).count() == 0
    # one id with one text is one document; with other texts it is several, shorter ones among them
    same = [(7, f"{a} {b}")] * 30 + [(7, a), (7, "short"), (8, a)]
    texts = [r.text for r in fm_dedup.rewrite(frame(spark, same)).collect()]
    assert texts.count("short") == 1
    assert (texts.count(f"{a} {b}"), texts.count(b), texts.count(a), texts.count("")) in ((30, 0, 0, 2), (0, 30, 1, 1))


# 8


def test_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.randrange(15, 60)))) for k in range(30)] + [(30, "so short"), (31, ""), (32, None)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(100)]
        if i % 2 == 0:
            part = items[i % 30][1].upper().split()
            if i % 4 == 0:
                part[len(part) // 2] = word()
            if i % 12 == 0:
                del part[2]
            w[40:40] = part
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "this is So SHORT indeed")]
    got = decontam.passages(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r for r in got.collect()}
    want = {}
    for i, t in docs:
        w = words(t)
        for k, x in items:
            q = words(x)
            width = min(5, len(q))
            bag = Counter(tuple(q[j : j + width]) for j in range(len(q) - width + 1)) if q else Counter()
            best = 0
            for a in range(len(w) - len(q) + 1) if q else ():
                other = Counter(tuple(w[a + j : a + j + width]) for j in range(len(q) - width + 1))
                best = max(best, sum((bag & other).values()) / sum((bag | other).values()))
            if best >= 0.8:
                want[i, k] = best
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: r.similarity for k, r in found.items()}
    assert len(want) > 10
    assert decontam.passages(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.passages(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_passages_in_documents_shorter_than_the_item(spark):
    w = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(w[:-1])), (2, " ".join(w[2:])), (3, " ".join(w[:20])), (4, " ".join(w)), (5, " ".join(w[:2])), (6, " ".join(w[:-1])[:-1])]
    got = decontam.passages(frame(spark, docs), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string"))
    assert {r.doc_id: (r.first_word, r.n_words, round(r.similarity, 6)) for r in got.collect()} == {1: (0, 39, round(35 / 36, 6)), 2: (0, 38, round(34 / 36, 6)), 4: (0, 40, 1.0), 6: (0, 39, round(34 / 37, 6))}


def test_repeated_items_and_small_blocks(spark, monkeypatch):
    """Equal items are one, however many; blocks are bounded by bytes; of equal windows the first counts; texts may be long."""
    w = [f"w{i}" for i in range(30)]
    one = " ".join(w)
    rows = [(9, one)] * 50_000 + [(4, one), (5, one)] + [(20 + i, " ".join(f"x{i}y{k}" for k in range(20))) for i in range(20)] + [(None, one)]
    docs = [(1, f"a {one} b {one}"), (1, one), (2, " ".join(["pad"] * 30_000 + w + [f"q{i}" for i in range(20_000)] + w[:29])), (3, " ".join(f"x7y{k}" for k in range(20)))]
    monkeypatch.setattr(decontam, "ITEM_BYTES", 400)
    got = decontam.passages(frame(spark, docs), spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_items, r.first_word, r.similarity) for r in got) == [(1, 4, 3, 0, 1.0), (1, 4, 3, 1, 1.0), (2, 4, 3, 30_000, 1.0), (3, 27, 1, 0, 1.0)]


def test_recall_near_the_threshold():
    """Of windows with similarity 0.80 to 0.85, the share within the radius of their item."""
    rng, near, all_ = np.random.default_rng(8), 0, 0
    while all_ < 2000:
        item = rng.integers(1, 1 << 60, 60).astype(np.uint64)
        other = item.copy()
        other[rng.choice(60, rng.integers(1, 3), replace=False)] = rng.integers(1, 1 << 60)
        a, b = (decontam.wb.shingles(x, 5) for x in (item, other))
        s = decontam.weighted_similarity(Counter(a.tolist()), Counter(b.tolist()))
        if 0.8 <= s <= 0.85:
            all_ += 1
            p, q = (decontam.simhash(decontam._signs(x).sum(0, keepdims=True))[0] for x in (a, b))
            near += int(np.bitwise_count(p ^ q).sum()) <= decontam.RADIUS
    assert near / all_ > 0.99


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    items = decontam.Items(np.arange(50), [rng.integers(1, 1 << 60, 12).astype(np.uint64) for _ in range(50)])
    prints = items.by_size[12]["prints"]
    bits = np.unpackbits(prints, axis=1)
    for _ in range(200):
        k = rng.integers(50)
        flip = bits[k].copy()
        flip[rng.choice(128, rng.integers(0, decontam.RADIUS + 1), replace=False)] ^= 1
        q = np.packbits(flip)[None]
        want = {j for j in range(50) if np.bitwise_count(prints[j] ^ q[0]).sum() <= decontam.RADIUS}
        assert {c for _, c, _ in items.candidates(12, q)} == want and k in want
