import re

import pytest
from evwatch.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, tests, size=13):
    windows = {}
    for k, t in tests:
        w = words_of(t)
        for i in range(max(len(w) - size + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(k))
    lengths, out = {len(w) for w in windows}, []
    for k, t in docs:
        w, hit, items = words_of(t), set(), set()
        for n in lengths if k is not None else ():
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((k, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def check(docs, tests):
    order = lambda x: (str(x[0]), x[1:3])
    got = [tuple(r) for r in decontaminate.contamination(docs, tests).collect()]
    want = brute(*([tuple(r) for r in df.select(c, "text").collect()] for df, c in ((docs, "doc_id"), (tests, "item_id"))))
    assert sorted(got, key=order) == sorted(want, key=order)
    return got


@pytest.mark.parametrize("blocks", [False, True])
def test_whole_table_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 5000)
    got = check(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert any(r[4] for r in got) and not all(r[4] for r in got)


def test_odd_rows(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    tests = [(1, item), (2, "only three words"), (3, None), (4, ""), (5, "the the the the"), (6, "ωmega 123"), (None, "nobody knows"), (7, item), (8, "word")]
    rows = [(1, "x " + item.upper() + " y"), (1, "x " + item.upper() + " y"), (2, item.replace("gamma", "other")), (3, None), (4, ""), (5, "ONLY-three_words"), (6, "the the the the the"), (7, "Ωmega ωmega 123"),
            (None, item), (8, "z " * 300 + item), (9, "only three " * 20_000), (10, "word"), (11, "nobody knows")]
    docs = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, term string")
    bench = spark.createDataFrame([(k, t, 1) for k, t in tests if k is not None], "item_id long, text string, at int")
    check(docs, bench)
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, None, 9, 11} | {k for k, *_, bad in brute(rows, [t for t in tests if t[0] is not None]) if not bad}
    nothing = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(nothing) == len(rows) and not any(r.contaminated for r in nothing)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    tests = spark.createDataFrame([(1, "rare common words stand unusual here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "rare things and unusual ones"), (2, "rare common words stand unusual here"), (3, "rare"), (4, "unusual x y z rare")], "doc_id long, text string")
    got = {(r.doc_id, r.kind) for r in decontaminate.matches(docs, tests).collect()}
    assert (2, "exact") in got and {k for k, kind in got if kind == "exact"} == {2} and 3 not in {k for k, _ in got}


def test_native(spark):
    plan = queries.op7_decontaminate(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
