import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evwatch.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def test_composed_checksums():
    rnd = random.Random(3)
    pairs = [(rnd.randbytes(rnd.randrange(0, 40)), rnd.randbytes(rnd.choice([0, 1, 2, 7, 31, 1000, 70_000]))) for _ in range(60)]
    left, right = (np.array([zlib.crc32(x[k]) for x in pairs], np.uint32) for k in (0, 1))
    got = resampling.composed(left, right, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_buckets_equal_hashed_runs(n, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 50)  # so that texts are cut
    texts = ["The Cat the CAT, sat-on été été2 x", "", "one", "a a a a a a", "ÄÖ\x00\x7fß 日本 語" * 40, " lead and trail ", "w" * 300 + " b"]
    for text, (crc, length) in zip(texts, resampling.payloads([t.encode() for t in texts]), strict=True):
        assert sorted(resampling.buckets_of(crc, length, n, 997).tolist()) == sorted(x % 997 for x in features(text, n))


def brute(docs, target, n, buckets, percent, least):
    s, t = (Counter(x % buckets for text in texts for x in features(text, n)) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        f = features(text, n)
        weight = sum(gain[x % buckets] for x in f) // max(1, len(f))
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        score = None if doc_id is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words(text)), len(f), weight, score, None])
    can = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(can[: len(can) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (2, 50)])
def test_equals_brute_force(spark, n, percent):
    rnd = random.Random(n)
    vocabulary = [f"w{k}" for k in range(60)] + ["naïve", "ÉTÉ", "Q"]
    docs = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 60)))) for k in range(80)]
    docs += [(100, None), (101, ""), (102, "..."), (None, "w1 " * 30), (103, "w1 w2 " * 40_000), (104, "w3 " * 25), (105, "w3 " * 25), (3, docs[3][1])]
    target = [" ".join(rnd.choices(vocabulary[:20], k=30)) for _ in range(10)] + [None]
    rows = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, bucket int, place int, score string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(rows, items, most_words=n, buckets=500, percent=percent).collect()
    want = brute(docs, target, n, 500, percent, 20)
    assert sorted(map(tuple, got), key=repr) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(k, f"a b c {k} " * 10) for k in range(10)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    got = resampling.resample(some, none.select("text"), percent=100).collect()
    assert sorted(x["rank"] for x in got) == list(range(1, 11))
