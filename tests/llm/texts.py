"""Small corpora and plain Python versions of the definitions."""

import random
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOW) if lower else text)


def corpus(seed=3, n=90):
    """(doc_id, text): fresh texts, exact and near copies, shared passages, short, empty, null and repetitive texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randrange(1, 8))) for _ in range(400)] + ["The", "of", "and"] * 60
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = fresh(60), fresh(120)
    out = []
    for i in range(n):
        kind = i % 9
        if kind == 0 and i:
            text = out[rng.randrange(len(out))][1]
        elif kind == 1:
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 2:
            text = " ".join(fresh(rng.randrange(5, 40)) + passage + fresh(rng.randrange(5, 40)))
        elif kind == 3:
            text = " ".join(fresh(rng.randrange(0, 5)))
        elif kind == 4:
            text = " ".join([rng.choice(vocabulary)] * rng.randrange(20, 60))
        elif kind == 5:
            text = None if i % 2 else ""
        else:
            text = "\t\n".join(fresh(rng.randrange(20, 300)))
        out.append((i, text))
    return out


def frame(spark, rows, extra=True):
    """Documents with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", F.lit("x").alias("n"), F.lit(1).alias("key"), F.lit("y").alias("runs"), F.lit(0.5).alias("score")) if extra else df


def held(doc_id, parts, which):
    return zlib.crc32(str(doc_id).encode()) % parts == which


def similar(rows):
    """doc_id -> (set size, component) by all pairs."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = root(a), root(b)
                    label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def stripped(rows, window=20):
    """doc_id -> (words, words kept)."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t, lower=False)
        gone = set()
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone.update(range(k, k + window))
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out
