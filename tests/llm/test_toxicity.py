import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evwatch.llm import toxicity as T


def spectrum(unit):
    """Subsequences of three symbols with their weights, from the definition."""
    sym = [0, *T.symbols()[[ord(c) for c in unit]].tolist(), 0]
    found = Counter()
    for i, j, k in combinations(range(len(sym)), 3):
        if k - i < T.SPAN and min(sym[i], sym[j], sym[k]) >= 0:
            found[(sym[i] * T.SYMBOLS + sym[j]) * T.SYMBOLS + sym[k]] += T.DECAY ** (k - i + 1)
    return found


def kernel(a, b):
    x, y = spectrum(a), spectrum(b)
    dot = sum(w * y[c] for c, w in x.items())
    return dot / max((sum(w * w for w in x.values()) * sum(w * w for w in y.values())) ** 0.5, 1e-9)


UNITS = ["idiot", "i.d.i.o.t", "id##iot", "idiot###", "aaaaaa", "a", "été", "banana", "x1x1x1", "-", "idioms", "日本語だ"]


def test_kernel_equals_definition():
    table, column = T.spread(UNITS)
    got = T.kernels(UNITS, table, column)
    want = np.array([[kernel(a, b) for b in UNITS] for a in UNITS])
    assert np.abs(got - want).max() < 1e-5


def test_folded_machine_equals_landmark_form():
    rnd = random.Random(1)
    units = ["".join(rnd.choices("abcdefghij.", k=rnd.randrange(2, 13))) for _ in range(120)]
    y, weight = np.array([1.0 if "a" in u else -1.0 for u in units]), np.ones(120)
    landmarks = units[:30]
    machine = T.fitted(units, y, weight, landmarks, 5.0)
    # The same machine by its kernels: K(u, L) alpha + bias reproduces the folded score.
    gram = np.array([[kernel(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-4 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    k = np.array([[kernel(u, b) for b in landmarks] for u in units])
    w, bias = T.separated(k @ root, y, weight, 5.0)
    plain = k @ root @ w + bias
    has = np.array([len(spectrum(u)) > 0 for u in units])
    assert np.abs(machine.score(units)[has] - np.maximum(plain[has], T.NOTHING)).max() < 2e-2
    assert (np.sign(plain) == y).mean() > 0.9


def test_long_units_score_as_their_best_window():
    machine = T.Machine(np.zeros(T.SYMBOLS**3, np.float32), 0.0)
    for c, w in spectrum("idiot").items():
        machine.weights[c] = w
    long = "q" * 1000 + "idiot" + "q" * 3000
    assert machine.score([long])[0] > 0.05 > machine.score(["q" * 4000])[0]


INSULTS = ["grumblor", "vexnick", "snarpel", "dolthead"]


def corpus(seed, n, bent=False):
    rnd = random.Random(seed)
    common = ["".join(rnd.choices("aeioustrnlmdh", k=rnd.randrange(2, 9))) for _ in range(400)]
    rows = []
    for k in range(n):
        text, toxic = [rnd.choice(common) for _ in range(rnd.randrange(20, 120))], k % 4 == 0
        for _ in range(3 * toxic):
            word = rnd.choice(INSULTS)
            if bent:
                at = rnd.randrange(2, len(word) - 1)
                word = rnd.choice([".".join(word), " ".join(word), word[:at] + "#*" + word[at:], word + "###"])
            text.insert(rnd.randrange(len(text)), word)
        rows.append((k, " ".join(x + "." * (rnd.random() < 0.1) for x in text), int(toxic)))
    return rows


def test_held_out_accuracy_and_bent_insults():
    rows = corpus(1, 300)
    model = T.train([x[1] for x in rows], [x[2] > 0 for x in rows], n_landmarks=64, most_units=1000, rounds=3)
    for test, least in ((corpus(2, 200), 0.98), (corpus(3, 200, bent=True), 0.9)):
        got = model.score([x[1] for x in test]) >= 0.5
        want = np.array([x[2] > 0 for x in test])
        assert (got == want).mean() >= least


def test_rows_of_all_kinds(spark):
    rows = corpus(4, 200)
    docs = [(k, text) for k, text, _ in rows] + [(None, "vexnick"), (900, None), (901, ""), (902, "a b c " * 100_000), (903, "..."), (5, rows[5][1])]
    labels = [(k, toxic) for k, _, toxic in rows] + [(None, 1), (7, None), (9, 1), (9, 0), (9999, 1)]
    d = spark.createDataFrame([(*x, "en", 5) for x in docs], "doc_id long, text string, lang string, score int")
    known = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, toxic int, quality int")
    out = T.toxicity(d, known, n_landmarks=64, most_units=1000, rounds=3).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(x[0] for x in docs)
    for x in out:
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5)
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
    held = [x for x in out if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 200]
    assert sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in held) / len(held) >= 0.9


def test_held_out_labels_and_other_columns_change_nothing(spark):
    rows = corpus(5, 120)
    d = spark.createDataFrame([(k, t, "en") for k, t, _ in rows], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    turned = known.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    how = {"n_landmarks": 32, "most_units": 500, "rounds": 2}
    a, b = ({(x["doc_id"], x["score"]) for x in T.toxicity(x, y, **how).collect()} for x, y in ((d, known), (d.withColumn("lang", F.lit("xx")), turned)))
    assert a == b


@pytest.mark.parametrize("toxic", [[], [1], [0]])
def test_without_labels_of_both_kinds(spark, toxic):
    d = spark.createDataFrame([(k, "some words here") for k in range(4)], "doc_id long, text string")
    known = spark.createDataFrame([(1, y) for y in toxic], "doc_id long, toxic int")
    got = {x["score"] for x in T.toxicity(d, known).collect()}
    assert len(got) == 1 and 0 <= got.pop() <= 1
    assert T.toxicity(d.limit(0), known).count() == 0
