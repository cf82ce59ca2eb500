"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

A unit is a word, or a run of letters spelled out one by one. The kernel of two units sums over
all subsequences of three characters that both have, each weighted by ``DECAY`` to the power of the
characters it spans, ``SPAN`` at most, and is normalised. So a word keeps most of its likeness to
itself with characters put between its letters or behind it; marks are never matched, only spanned.

The machine is linear in Nyström features, which are made of the kernels with landmark units. A sum
over landmarks of kernels is a sum over subsequences of weights, so a fitted machine is one table of
a weight for each subsequence, and scoring a unit needs no landmark.

It is trained on sentences that have their document's label. Of a toxic document most sentences are
clean, so training goes in rounds: a toxic document's best units, by the machine so far, stand for its
sentences, against all units of the clean ones. A sentence scores as its highest unit; a logistic fit
turns a document's highest sentences, how many are over the margin and how many it has into a
probability. That fit sees scores by machines which didn't see the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwatch.llm import common

DECAY, SPAN, SYMBOLS = 0.7, 7, 64
#: The weight of a subsequence by the characters that it spans; 0 stands for none.
POWERS = np.append(0.0, DECAY ** np.arange(1, 8)).astype(np.float32)
#: Longer units are looked at through windows of so many characters, which start so many apart.
WIDTH, STEP = 16, 8
WIDTHS = (8, 12, WIDTH)
#: Units of a sentence at most; a longer one counts as several.
SENTENCE = 24
#: Characters of texts that are scored at once.
CHUNK = 1 << 21
SPELLED = re.compile(r"(?<!\S)\w(?:[^\w\n]{1,3}\w){2,}(?!\S)")
MARKS = re.compile(r"\W+")
BREAK, NOTHING = "\x00", -2.0
TOP = 3
BOUNDS = (-0.5, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.3)
FEATURES = TOP + 2 * len(BOUNDS) + 1


@cache
def symbols() -> np.ndarray:
    """A character's symbol: 0 is a unit's edge, -1 a mark, which only takes up room."""
    table = (37 + np.arange(0x110000) % 27).astype(np.int8)
    table[:128] = -1
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("0") : ord("9") + 1] = np.arange(27, 37)
    return table


@cache
def triples(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of three characters that span ``SPAN`` at most, and how many they span."""
    found = [(i, j, k) for i in range(width) for k in range(i + 2, min(i + SPAN, width)) for j in range(i + 1, k)]
    at = np.array(found).T
    return at, at[2] - at[0] + 1


def windows(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit numbers and symbols of windows of equal width, edges included."""
    size = np.fromiter(map(len, units), np.int64, len(units))
    sym = symbols()[np.frombuffer("".join(units).encode("utf-32-le", "replace"), np.uint32)]
    first = np.cumsum(size) - size
    n = np.maximum(1, -(-(size + 2 - WIDTH) // STEP) + 1)
    unit = np.repeat(np.arange(len(units)), n)
    start = (np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)) * STEP - 1
    reach = np.minimum(size[unit] + 1 - start, WIDTH)
    low = 0
    for width in WIDTHS:
        here = np.flatnonzero((reach > low) & (reach <= width))
        low = width
        for part in np.array_split(here, max(1, len(here) // 20_000)):
            if len(part):
                at = start[part, None] + np.arange(width)
                inside = (at >= 0) & (at < size[unit[part], None])
                letters = sym[np.where(inside, first[unit[part], None] + at, 0)] if len(sym) else np.zeros(at.shape, np.int8)
                edge = (at == -1) | (at == size[unit[part], None])
                yield unit[part], np.where(inside, letters, np.where(edge, 0, -1))


def subsequences(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its subsequences as numbers, sorted, their weights and the root of its kernel with
    itself."""
    (i, j, k), span = triples(letters.shape[1])
    letters = letters.astype(np.int32)
    a, b, c = (letters[:, x] for x in (i, j, k))
    packed = np.where((a | b | c) >= 0, (((a * SYMBOLS + b) * SYMBOLS + c) << 3) + span.astype(np.int32), 0)
    packed.sort(axis=1)
    code, weight = packed >> 3, POWERS[packed & 7]
    own = np.einsum("rt,rt->r", weight, weight)
    rows, codes, weights = np.arange(len(code)), code, weight
    for d in range(1, code.shape[1]):  # a subsequence that a unit has several times
        equal = (codes[:, d:] == codes[:, :-d]) & (weights[:, :-d] > 0)
        here = np.flatnonzero(equal.any(1))
        if not len(here):
            break
        rows, codes, weights, equal = rows[here], codes[here], weights[here], equal[here]
        own[rows] += 2 * np.einsum("rt,rt,rt->r", weights[:, d:], weights[:, :-d], equal)
    return code, weight, np.sqrt(own)


@dataclass
class Machine:
    """A weight for each subsequence, and what is added."""

    weights: np.ndarray
    bias: float

    def score(self, units: list[str]) -> np.ndarray:
        """Each unit's side of the margin; ``NOTHING`` for one without three characters."""
        out = np.full(len(units), NOTHING)
        for unit, letters in windows(units):
            code, weight, norm = subsequences(letters)
            told = np.einsum("rt,rt->r", self.weights[code], weight) / np.maximum(norm, 1e-9) + self.bias
            np.maximum.at(out, unit, np.where(norm > 0, told, NOTHING))
        return out


def kernels(units: list[str], landmarks: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Kernels of units with landmarks: rows of ``landmarks`` are subsequences, by ``column``; of a long
    unit's windows the last one's."""
    out = np.zeros((len(units), landmarks.shape[1]), np.float32)
    for unit, letters in windows(units):
        for part in np.array_split(np.arange(len(unit)), max(1, len(unit) // 500)):
            code, weight, norm = subsequences(letters[part])
            out[unit[part]] = np.einsum("rt,rtm->rm", weight / np.maximum(norm, 1e-9)[:, None], landmarks[column[code]])
    return out


def spread(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised weights of the landmarks' subsequences, a row for each subsequence that any has and
    row 0 for others, and the row of each subsequence."""
    found: Counter[tuple[int, int]] = Counter()
    for unit, letters in windows(landmarks):
        code, weight, norm = subsequences(letters)
        for r, u in enumerate(unit.tolist()):
            for c, w in zip(code[r].tolist(), (weight[r] / max(norm[r], 1e-9)).tolist(), strict=True):
                if w:
                    found[c, u] += w
    codes = sorted({c for c, _ in found})
    column = np.zeros(SYMBOLS**3, np.int32)
    column[codes] = np.arange(1, len(codes) + 1)
    table = np.zeros((len(codes) + 1, len(landmarks)), np.float32)
    for (c, u), w in found.items():
        table[column[c], u] = w
    return table, column


def separated(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton's method."""
    z = np.hstack([z, np.ones((len(z), 1), z.dtype)]).astype(np.float64)
    ridge = np.full(z.shape[1], 1.0)
    ridge[-1] = 1e-3
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        return 0.5 * (ridge * w * w).sum() + cost * (weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()

    for _ in range(20):
        active = y * (z @ w) < 1
        za, ya, ca = z[active], y[active], 2 * cost * weight[active]
        slope = ridge * w - za.T @ (ca * (ya - za @ w))
        step = np.linalg.solve(np.diag(ridge) + (za * ca[:, None]).T @ za, slope)
        size, now = 1.0, loss(w)
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fitted(units: list[str], y: np.ndarray, weight: np.ndarray, landmarks: list[str], cost: float) -> Machine:
    """The machine of labelled units, its Nyström features folded into weights of subsequences."""
    table, column = spread(landmarks)
    values, vectors = np.linalg.eigh((table.T @ table).astype(np.float64))
    kept = values > 1e-4 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    w, bias = separated(kernels(units, table, column) @ root.astype(np.float32), y, weight, cost)
    by_code = table @ (root @ w)
    by_code[0] = 0.0
    return Machine(by_code[column].astype(np.float32), bias)


def units_of(text: str) -> list[str]:
    """A text's units in order, with breaks between sentences; runs of letters that are spelled out follow,
    put together, each a sentence."""
    text = text.lower()
    spelled = [x for m in SPELLED.finditer(text) for x in (BREAK, MARKS.sub("", m[0]))]
    return text.replace(BREAK, " ").replace("\n", f" {BREAK} ").split() + spelled


def sentence_ends(units: list[str]) -> np.ndarray:
    return np.fromiter((u[-1] in ".!?\x00…。" for u in units), bool, len(units))


class Batch:
    """Texts as numbers of their distinct units, cut into sentences."""

    def __init__(self, texts: list[str]):
        lists = [units_of(x) for x in texts]
        every = list(chain.from_iterable(lists))
        self.units = list(dict.fromkeys(every))
        known = dict(zip(self.units, range(len(self.units)), strict=True))
        self.ids = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        doc = np.repeat(np.arange(len(lists)), self.sizes)
        fresh = np.ones(len(doc), bool)
        if len(doc):
            fresh[1:] = (doc[1:] != doc[:-1]) | sentence_ends(self.units)[self.ids[:-1]]
            at = np.arange(len(doc))
            fresh |= (at - np.maximum.accumulate(np.where(fresh, at, 0))) % SENTENCE == 0
        self.first = np.flatnonzero(fresh)
        self.doc = doc[self.first]

    def sentences(self, scores: np.ndarray) -> np.ndarray:
        """The highest score in each sentence."""
        return np.maximum.reduceat(scores[self.ids], self.first) if len(self.first) else np.zeros(0)

    def features(self, scores: np.ndarray) -> np.ndarray:
        """By document: its highest sentences, how many are over each of ``BOUNDS``, also as a share, and how many
        there are."""
        told, n = self.sentences(scores), len(self.sizes)
        count = np.bincount(self.doc, minlength=n)
        order = np.lexsort((-told, self.doc))
        place = np.arange(len(told)) - np.repeat(np.cumsum(count) - count, count)
        top = np.full((n, TOP), NOTHING)
        kept = place < TOP
        top[self.doc[order][kept], place[kept]] = told[order][kept]
        bins = np.bincount(self.doc * (len(BOUNDS) + 1) + np.searchsorted(BOUNDS, told), minlength=n * (len(BOUNDS) + 1)).reshape(n, -1)[:, 1:]
        # All that are over a bound, so that what lies between clean and toxic ones counts as well.
        bins = np.cumsum(bins[:, ::-1], axis=1)[:, ::-1]
        share = np.sqrt(bins / np.maximum(count, 1)[:, None])
        return np.column_stack([np.clip(top, NOTHING, 2), np.log1p(bins), share, np.log1p(count)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of features and a constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    machine: Machine
    calibration: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        batch = Batch(texts)
        x = batch.features(self.machine.score(batch.units))
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration[:-1] + self.calibration[-1], -30, 30)))


def by_hash(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit, 7)


def train_machine(texts: list[str], toxic: np.ndarray, n_landmarks: int, most_units: int, rounds: int, cost: float) -> Machine:
    """Rounds of choosing the units that stand for toxic documents' sentences, and fitting."""
    batch = Batch(texts)
    doc = np.repeat(np.arange(len(texts)), batch.sizes)
    pairs = np.unique(doc * len(batch.units) + batch.ids)
    doc, unit = pairs // len(batch.units), pairs % len(batch.units)
    n_toxic = np.bincount(unit[toxic[doc]], minlength=len(batch.units))
    n_clean = np.bincount(unit[~toxic[doc]], minlength=len(batch.units))
    hashes = np.array([by_hash(u) for u in batch.units], np.uint64)

    def most(among: np.ndarray, worth: np.ndarray, n: int) -> np.ndarray:
        return among[np.lexsort((hashes[among], -worth[among]))[:n]]

    all_clean = np.flatnonzero(n_clean)
    base = clean = most(all_clean, n_clean, most_units // 2)
    expected = (n_toxic + n_clean) * toxic.mean()
    excess, half, nought = (n_toxic - expected) / np.sqrt(expected + 1), n_landmarks // 2, np.zeros(len(hashes))
    picked = apart = most(np.flatnonzero(n_toxic), excess, half)
    share, against = n_toxic / toxic.sum(), most(clean, nought, n_landmarks - half)
    for _ in range(rounds):
        chosen = [*picked.tolist(), *clean.tolist()]
        y = np.repeat([1.0, -1.0], [len(picked), len(clean)])
        landmarks = list(dict.fromkeys([*apart.tolist(), *against.tolist()]))
        machine = fitted([batch.units[u] for u in chosen], y, np.concatenate([share[picked], n_clean[clean] / max(1, (~toxic).sum())]), [batch.units[u] for u in landmarks], cost)
        scores = machine.score(batch.units)
        here = toxic[doc]
        order = np.lexsort((unit[here], -scores[unit[here]], doc[here]))
        d, u = doc[here][order], unit[here][order]
        head = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        place = np.arange(len(d)) - np.repeat(head, np.diff(np.append(head, len(d))))
        stands = np.bincount(u[(place < 2 * TOP) & (scores[u] > 0)], minlength=len(hashes))
        if stands.any():
            share, picked = stands / toxic.sum(), most(np.flatnonzero(stands), stands, most_units)
            apart = most(picked, stands, half)
        # Clean units that the machine takes for toxic are what it must learn next.
        hard = most(all_clean, scores, most_units // 2)
        clean = np.union1d(np.intersect1d(clean, most(clean, scores, most_units)), np.union1d(base, hard))
        near = hard[: (n_landmarks - half) // 2]
        against = np.concatenate([near, most(clean, nought, n_landmarks - half - len(near))])
    return machine


def train(texts: list[str], toxic: list[bool], share: float | None = None, n_landmarks: int = 192, most_units: int = 8_000, rounds: int = 4, cost: float = 100.0) -> Model:
    """The model of labelled texts, for documents of which ``share`` are toxic; as many as here, if none is
    given. Without both labels its score is the toxic share, drawn towards a half."""
    y = np.array(toxic, bool)
    if y.all() or not y.any():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(Machine(np.zeros(SYMBOLS**3, np.float32), -1.0), np.append(np.zeros(FEATURES), np.log(share / (1 - share))))
    how = (n_landmarks, most_units, rounds, cost)
    x = np.zeros((len(texts), FEATURES))
    fold = np.zeros(len(texts), int)
    for side in (False, True):
        fold[y == side] = np.arange((y == side).sum()) % 2
    for k in (0, 1):
        seen, unseen = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not y[seen].any() or y[seen].all():
            seen = np.arange(len(texts))
        machine = train_machine([texts[i] for i in seen], y[seen], *how)
        batch = Batch([texts[i] for i in unseen])
        x[unseen] = batch.features(machine.score(batch.units))
    calibration = logistic(x, y.astype(float))
    if share is not None:
        calibration[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(train_machine(texts, y, *how), calibration)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, most_rows: int, longest: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[bool], float]:
    """At most ``most_rows`` texts of either label, of ids with ``learn``, by the hash of the id and
    with at most ``longest`` characters, on the driver; and the toxic share of all of which they are a
    sample. An id with labels of both kinds is left out."""
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).alias("least"), F.max(label_col).alias("__toxic"))
    known = known.where("least = __toxic").select("__id", (F.col("__toxic") > 0).alias("__toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    short = texts.where(F.length("__text") <= longest)
    known = common.stored(known.join(short.select("__id"), "__id", "left_semi"))
    share = known.agg(F.avg(F.col("__toxic").cast("double"))).first()[0]
    rows: list[tuple[int, str, bool]] = []
    for side in (False, True):
        picked = known.where(F.col("__toxic") == side).orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
        of = short.join(F.broadcast(picked), "__id")  # most_rows at most
        found = of.groupBy("__id").agg(F.min("__text").alias("text")).collect()
        rows += [(x["__id"], x["text"], side) for x in found]
    rows.sort(key=lambda x: (by_hash(str(x[0])), x[0]))
    return [x[1] for x in rows], [x[2] for x in rows], share or 0.0


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs``; a null text is empty."""
    common.importable(docs.sparkSession)
    weights, bias, calibration = model.machine.weights.tobytes(), model.machine.bias, model.calibration.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(Machine(np.frombuffer(weights, np.float32), bias), np.array(calibration))
        for batch in batches:
            scores: list[float] = []
            texts: list[str] = []
            size = 0
            for text in (x.as_py() or "" for x in batch.column(1)):
                texts.append(text)
                size += len(text)
                if size >= CHUNK:
                    scores += own.score(texts).tolist()
                    texts, size = [], 0
            scores += own.score(texts).tolist() if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 2_000, longest: int = 20_000, **how) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``: every fifth id, by its CRC-32, is held
    out and its label isn't learned from. ``how``: of ``train``.

    The model is fitted on the driver on a bounded sample (``most_rows`` of either label, ``longest``
    characters a text); all rows and whole texts are scored. A null or empty text is scored as a
    document without sentences; repeated rows each give a row; a row without an id is scored but
    never learned from; labels without a document, null labels and ids labelled both ways don't
    count. Without labels of both kinds all scores are one number. Other columns are not looked at.
    Ids must be numbers.
    """
    texts, toxic, share = labelled_sample(docs, labels, ~held_out(id_col), most_rows, longest, id_col, text_col, label_col)
    scored = score_texts(docs, train(texts, toxic, share, **how), id_col, text_col)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
