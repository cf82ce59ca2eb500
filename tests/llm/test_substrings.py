import numpy as np
import pytest
from evwatch.llm import substrings, suffixes

SF = "/root/testdata/sf0.001"


def brute_order(texts):
    """Suffixes as (codes, then the segment's terminator), sorted."""
    at, out = 0, []
    for k, t in enumerate(texts):
        out += [([b + 1 for b in t[i:]] + [0], k, at + i) for i in range(len(t))]
        at += len(t)
    return [x[2] for x in sorted(out)]


def shard(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


@pytest.mark.parametrize("seed", range(25))
def test_order_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(0, 1 + seed % 4, rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
    text, ends = shard(texts)
    order, rank = suffixes.suffix_array(text, ends)
    assert order.tolist() == brute_order(texts) and rank[order].tolist() == list(range(len(text)))
    tail = [text[i : ends[np.searchsorted(ends, i, "right")]].tobytes() for i in range(len(text))]
    lcp = suffixes.common_prefixes(text, ends, order)
    for j in range(1, len(order)):
        a, b = tail[order[j - 1]], tail[order[j]]
        assert lcp[j] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(10))
def test_merged_shards_equal_one(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 100, rng.integers(4, 60)).astype(np.uint8)) for _ in range(30)]
    owner = rng.integers(0, 9, 30)
    least = {}
    for t, o in zip(texts, owner):
        for i in range(len(t) - 4):
            least[t[i : i + 5]] = min(o, least.get(t[i : i + 5], o))
    for cuts in ([0, 30], [0, 10, 20, 30], [0, 1, 29, 30]):
        parts = [(*shard(texts[i:j]), owner[i:j]) for i, j in zip(cuts, cuts[1:])]
        n = 0
        for (text, ends, _), (at, got) in zip(parts, suffixes.least_owners(parts, 5)):
            n += len(at)
            assert all(least[text[a : a + 5].tobytes()] == g for a, g in zip(at.tolist(), got.tolist()))
        assert n == sum(max(0, len(t) - 4) for t in texts)


def brute(rows, length):
    first = {}
    for k, t in sorted((k, (t or "").encode()) for k, t in rows if k is not None):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], k)
    out = []
    for k, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        if k is not None:
            for i in range(len(t) - length + 1):
                if first[t[i : i + length]] < k:
                    gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out.append((k, len(t), int(gone.sum()), edges.reshape(-1, 2).tolist(), kept))
    return out


def check(docs, length=50):
    order = lambda x: (x[0] is None, x[0] or 0, x[4])
    got = [(r.doc, r.n_bytes, r.n_removed, [[s.start, s.end] for s in r.spans], bytes(r.kept)) for r in substrings.drop_repeats(docs, length=length).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], length)
    assert sorted(got, key=order) == sorted(want, key=order)
    return got


@pytest.mark.parametrize("small", [False, True])
def test_whole_table_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("CHUNK", 20_000), ("BUCKET", 50_000), ("SHARD", 2_000), ("HOT", 3)):
            monkeypatch.setattr(substrings, name, value)
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(r[2] for r in got) > 10_000


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(150_000))
    passage = "Ein Absatz, der in vielen Texten vorkommt: äöü ß, und noch etwas länger ist als fünfzig Bytes."
    rows = [(5, passage), (3, "x" + passage + "y"), (3, "x" + passage + "y"), (3, "other " + passage), (7, None), (8, ""), (9, "a" * 5000), (10, "a" * 200 + "b" + "a" * 49),
            (11, "\0" * 300), (12, "\0" * 51 + "z"), (None, passage), (None, None), (20, long), (21, long[:70_000] + "é" + long[70_000:]), (-4, "y" + passage), (22, passage[:49]), (23, "Q" + passage[1:-1])]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, kept string, doc int")
    check(docs)
    check(docs, 24)
    assert substrings.drop_repeats(docs.limit(0)).count() == 0
