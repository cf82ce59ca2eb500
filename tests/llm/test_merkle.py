import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from evwatch.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, i long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return digest("".join(map(field, (r[0], r[3], r[2], r[4], text))))


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def along(levels, i):
    """Siblings left and right, level by level."""
    out = []
    for level in levels[:-1]:
        low = i // 8 * 8
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + 8])))
        i //= 8
    return out


def brute(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in order:
        parts[p].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[p] = levels_of([leaf_of(r, r[1]) for r in parts[p]])
    top = levels_of([trees[p][-1][0] for p in order])
    found = []
    for k, p in enumerate(order):
        for i, r in enumerate(parts[p]):
            path = along(trees[p], i) + along(top, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf_of(r, lowered(r[1]) if changed else r[1])
            for left, right in path:
                h = digest(left + h + right)
            found.append((r[0], trees[p][0][i], trees[p][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(found, key=repr)


def told(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    out = merkle.manifest(merkle.leaves(docs, tampered=changed))
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", "verified").collect()
    return sorted((tuple(x) for x in got), key=repr)


def test_equals_brute_force(spark):
    rows = [(k * 7 % 1009, f"Text {k} É" * (k % 3), "en" if k % 3 else "de", f"s{k % 4}", k) for k in range(75)]
    rows += [(None, "no ID", "en", None, None), (5000, None, "en", "s", 0), (5001, "", None, "s", 0), (5001, "", None, "s", 0), (5002, "ALONE", "xx", "s", 5)]
    rows += [(5002, "other", "en", "s", 5), (5003, "long " * 50_000, "fr", "s", 1)]
    assert told(spark, rows) == brute(rows)


def test_many_parts_and_one_row(spark):
    rows = [(k, f"T{k}", f"l{k:02d}", "s", k) for k in range(19)]
    assert told(spark, rows) == brute(rows)
    assert told(spark, rows[:1]) == brute(rows[:1])


def test_empty(spark):
    assert told(spark, []) == []


@pytest.mark.parametrize("n", [8, 9, 64, 65])
def test_full_runs(spark, n):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(n)]
    got = told(spark, rows)
    assert got == brute(rows)
    assert all(x[-1] for x in got)  # nothing to lower
