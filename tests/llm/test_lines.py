import re

from evwatch.llm import lines

SF = "/root/testdata/sf0.001"


def brute(rows, run=3, words=50):
    docs = {}
    for k, t in sorted({(k, t) for k, t in rows if k is not None and t is not None}):
        cut = t.split("\n")
        docs[k, t] = (cut, [i for i, x in enumerate(cut) if re.search(r"[^ \t\x0B\f\r]", x)])

    def windows(cut, full):
        for n in range(1, run + 1):
            for at in range(len(full) - n + 1):
                lines = tuple(cut[i].rstrip(" ") for i in full[at : at + n])
                if n == run or sum(len(re.findall(r"[^ \t\x0B\f\r]+", x)) for x in lines) > words:
                    yield at, n, lines

    first = {}
    for (k, _), (cut, full) in docs.items():
        for at, _, key in windows(cut, full):
            first[key] = min(first.get(key, (k, at)), (k, at))
    out = []
    for k, t in rows:
        if (k, t) not in docs:
            out.append((k, t))
            continue
        cut, full = docs[k, t]
        gone, end = set(), -1
        for at, n, key in sorted(windows(cut, full)):
            if first[key] < (k, at):
                low = full[at] if at > end else full[end - 1]
                gone |= set(range(low, full[at + n - 1] + 1))
                end = max(end, at + n)
        out.append((k, "\n".join(x for i, x in enumerate(cut) if i not in gone)))
    return out


def check(docs):
    order = lambda x: (str(x[0]), str(x[1]))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = lines.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in got.select("doc_id", "text").collect()], key=order) == sorted(brute(rows), key=order)
    return rows


def test_whole_table_equals_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark):
    a = "one\ntwo\nthree\nfour"
    para, half = " ".join(f"w{i}" for i in range(51)), " ".join(f"v{i}" for i in range(26))
    long = "\n".join(f"line {i % 5000}" for i in range(20_000))
    rows = [(1, a), (2, a), (2, a), (3, "zero\n\none \ntwo\n\nthree\nfive"), (4, None), (5, ""), (6, "\n\n\n"), (7, "one\ntwo"), (None, a), (8, "same\n" * 10), (9, long), (10, "\t\none\n \ntwo\nthree"),
            (11, "p\none\ntwo\nthree\nq"), (12, "p\none\ntwo\nthree\nq"), (13, "one\ntwo\nthree\n\n\none\ntwo\nthree\n"), (-1, "two\nthree\nfour"), (30, "x\n" + para), (31, para + " \ny"), (32, half + "\n\n" + half + "\nz"), (33, "q\n" + half + "\n" + half), (34, half), (35, "w\n" + half), (36, para[:-3])]
    docs = spark.createDataFrame([(k, t, 3, [1]) for k, t in rows], "doc_id long, text string, `__runs` int, lines array<int>")
    check(docs)
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0
