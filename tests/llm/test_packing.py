import zlib

import numpy as np
import public_tokenizers
import pytest
from evwatch.llm import attribution, packing, tokens
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a  b", "x<|endoftext|>y", "²½ Ⅷ ́é", "日本語のテキスト", "\x1c\x1d a b", "it's we'll 1234 ???  \t end", "👩‍👩‍👧 ok"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_and_spans_equal_the_library(spark, reference):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    bpe = tokens.byte_bpe(tokens.default_path())
    for text in texts + [x for x in ODD if x]:
        want = reference.encode(text, add_special_tokens=False)
        ids = bpe.encode(text)
        assert ids.tolist() == want.ids
        starts, ends = attribution.token_spans(text, bpe.n_bytes[ids])
        assert (starts <= ends).all() and starts[0] == 0 and ends[-1] == len(text)
        if text.isascii() and "<|" not in text:
            trimmed = [(a + len(text[a:b]) - len(text[a:b].lstrip()), b) for a, b in zip(starts.tolist(), ends.tolist())]
            given = [(a, b) for a, b in want.offsets]
            assert all(b == d for (_, b), (_, d) in zip(trimmed, given) if text[:b].strip() == text[:b].rstrip() and text[b - 1 : b].strip())


def brute_cost(at, penalty, size):
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + size - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= size)
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 80))]).tolist()
    penalty = rng.choice([0.0, 2.0, 7.0], len(at)).tolist()
    path = packing.best_cuts(at, penalty, 16)
    cost = sum(16 - (at[b] - at[a]) + penalty[b] for a, b in zip(path, path[1:]))
    assert path[0] == 0 and path[-1] == len(at) - 1 and all(at[b] - at[a] <= 16 for a, b in zip(path, path[1:]))
    assert cost == brute_cost(at, penalty, 16)


def check(rows, texts, reference, size=2048):
    """Every id lies in one piece, sequences are gapless; returns the share of padding, but for the last sequence's."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts:
        want = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        got, at = b"", 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            got, at = got + r.ids, at + r.length
        assert np.frombuffer(got, "<u4").tolist() == want
    assert set(by_doc) == {k for k, _ in texts}
    held = 0
    for k, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        held += at * (k != max(by_sequence))
    return 1 - held / (size * max(len(by_sequence) - 1, 1))


def test_whole_table(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(packing.pack(docs).collect(), texts, reference) < 0.02
    small = packing.Plan(block=5000)
    assert check(packing.pack(docs, plan=small).collect(), texts, reference) < 0.04


def test_odd_texts(spark, reference):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(99, "word " * 60_000)]
    docs = spark.createDataFrame([(k, t, 7) for k, t in texts], "doc_id long, text string, ids int").coalesce(1)
    check(packing.pack(docs).collect(), texts, reference)
    again = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in packing.pack(again).collect()) == ["1", "1", "None"]
    assert packing.pack(docs.limit(0)).count() == 0


def brute_attribution(text, reference_spans, rule):
    lines = text.split("\n")
    bounds = [0]
    for i, line in enumerate(lines):
        bounds.append(bounds[-1] + len(line) + (i < len(lines) - 1))
    if bounds[-1] == bounds[-2] and len(bounds) > 2:
        bounds.pop()
    out = [0.0] * (len(bounds) - 1)
    for a, b in reference_spans:
        held = [max(0, min(b, bounds[k + 1]) - max(a, bounds[k])) for k in range(len(out))]
        if rule == "first":
            out[next(k for k, h in enumerate(held) if h)] += 1
        elif rule == "most":
            out[held.index(max(held))] += 1
        else:
            out = [x + h / (b - a) for x, h in zip(out, held)]
    return out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(spark, reference, rule):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*ODD, "a\n\n\n\nb\n", "\n"])], "doc_id long, text string")
    docs = docs.unionByName(odd)
    got = {}
    for r in attribution.attribute(docs, rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    bpe = tokens.byte_bpe(tokens.default_path())
    for doc_id, text in docs.collect():
        rows = sorted(got[doc_id], key=lambda r: r.section)
        text = text or ""
        ids = reference.encode(text, add_special_tokens=False).ids
        assert [r.doc_tokens for r in rows] == [len(ids)] * len(rows)
        assert abs(sum(r.n_tokens for r in rows) - len(ids)) < 1e-6
        assert rows[0].char_start == 0 and rows[-1].char_end == len(text)
        assert all(a.char_end == b.char_start for a, b in zip(rows, rows[1:]))
        spans, at = [], 0
        data = text.encode()
        for i in ids:
            end = at + len(bpe.vocabulary[i])
            spans.append((len(data[:at].decode(errors="ignore")), len(data[:end].decode(errors="replace").rstrip("�")) + (data[:end] != data[:end].decode(errors="ignore").encode())))
            at = end
        if text:
            assert np.allclose([r.n_tokens for r in rows], brute_attribution(text, spans, rule)), (text, spans)
    assert attribution.attribute(docs.limit(0)).count() == 0


def test_crc_is_unsigned(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = packing.pack(docs).selectExpr("crc32(ids) AS c", "ids").first()
    assert row.c == zlib.crc32(row.ids)
