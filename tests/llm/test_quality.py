import re
import unicodedata
from collections import Counter
from math import log2

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from evwatch.llm import quality
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def brute(text, bpe, pieces):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    ids = [i for w in words for i in bpe.encode(" " + w, add_special_tokens=False).ids]
    cut = [p for w in words for p in pieces.encode(w)]
    n_bytes = sum(pieces.is_byte(p) for p in cut)
    counts = Counter(ids).values()
    entropy = -sum(c / len(ids) * log2(c / len(ids)) for c in counts)
    chars = sum(map(len, words))
    return [len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(ids), n_bytes,
            chars / len(ids) if ids else 0.0, n_bytes / max(len(cut), 1), entropy]


def brute_band(text):
    names = {"LATIN": "latin", "GREEK": "greek", "CYRILLIC": "cyrillic", "HEBREW": "hebrew", "ARABIC": "arabic", "DEVANAGARI": "devanagari", "THAI": "thai", "HANGUL": "hangul", "HIRAGANA": "kana", "KATAKANA": "kana", "CJK": "han"}
    n = Counter(names.get(unicodedata.name(c, "?").split()[0].split("-")[0], "other") for c in text if c.isalpha())
    if n["kana"] * 10 >= n["han"] + n["kana"] > 0:
        n["kana"] += n.pop("han", 0)
    return quality.default_bands()[n.most_common(1)[0][0] if n else "latin"]


ODD = [None, "", " \n\t", "a", "a b c a b c", "日本 語 " * 40, "x\nx\nx \n\n\nx", "#*$%&|<> " * 60, "same words again " * 100, "q" * 30_000, "\U0001f600 " * 80, " ".join(f"слово{i} и дело{i % 9} пошло" for i in range(40)), " ".join(f"日本{chr(0x4e00 + i)}は東京です" for i in range(90)), " ".join(f"λόγος{i} και έργο" for i in range(40))]


@pytest.fixture(scope="module")
def models():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_measures_equal_brute_force(spark, models):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(ODD)], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd)
    texts, langs = ({r.doc_id: r[c] for r in docs.collect()} for c in ("text", "lang"))
    rows = quality.assess(docs, keep=["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id], *models)
        assert [r[c] for c in quality.LONGS] == want[:7], r
        assert all(abs(r[c] - x) < 1e-9 for c, x in zip(quality.DOUBLES, want[7:])), r
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        band = quality.default_bands().get(langs[r.doc_id]) or brute_band(texts[r.doc_id] or "")
        inside = band.least_chars <= want[7] <= band.most_chars and want[8] <= band.most_bytes and want[9] >= band.entropy + band.slope * log2(max(want[5], 1))
        assert r.base_failed == failed and r.kept == (inside and not failed)


def test_remembering_few_words_changes_nothing(models, monkeypatch):
    monkeypatch.setattr(quality, "KEPT_WORDS", 3)
    words = quality.Words(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for text in ODD:
        assert quality.measure(text or "", words)[:7] == brute(text, *models)[:7]


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = quality.assess(docs, keep=["doc_id", "quality"]).where("not base_failed").groupBy("quality").agg({"kept": "count", "*": "count"})
    kept = quality.assess(docs, keep=["doc_id", "quality"]).where("not base_failed").selectExpr("quality", "cast(kept AS double) AS k").groupBy("quality").avg("k")
    share = {r[0]: r[1] for r in kept.collect()}
    assert rows.count() == 2 and share[1] > 0.99 and share[0] < 0.5


def test_clean_keeps_columns_even_clashing_ones(spark):
    text = " ".join(f"word{i} and{i % 7} of{i % 11}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", 9, "n"), (None, text, None, None, None), (2, "short", "en", 1, "n"), (3, None, None, 1, "n")], "doc_id long, text string, lang string, n_words int, kept string")
    wide = quality.Rules(bands={k: quality.Band(0, 99, 1, 0, 0) for k in ("latin", "other")})
    out = quality.clean(docs, rules=wide)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "None"]
    assert {r.n_words for r in out.collect()} == {9, None}
    assert quality.clean(docs.limit(0)).count() == 0


def test_repeated_words_of_many_distinct_words():
    def brute(words, window):
        at = {}
        for i in range(len(words) - window + 1):
            at.setdefault(tuple(words[i : i + window]), []).append(i)
        return len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(window)})

    words = [*range(400), *range(50, 70), 7, *range(300, 308), *range(100, 109)]  # 9 words leave 7 bits for each
    assert quality.repeated_words(np.array(words), 9) == brute(words, 9) == 58
    many = np.concatenate([np.arange((1 << 21) + 5), [3, 4, 5]])
    assert quality.repeated_words(many) == 6
