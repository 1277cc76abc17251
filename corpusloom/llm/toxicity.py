"""Toxicity by a support vector machine over a subsequence string kernel.

Two strings are alike by the subsequences of three letters that they share; a
subsequence counts less the more letters lie between its own, so letters put
into an insult weaken a match but do not hide it.  The kernel is evaluated
against a bounded set of landmark strings (Nystroem's method): a text is
described by its best-matching word for each landmark, mapped by the inverse
square root of the landmarks' own kernel matrix, and judged by a linear
machine with Platt's probabilities.  The kernel enters as it is, which finds
disguised insults, and in a high power, which tells near words apart.
Landmarks are learnt from labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import discard, free_name, lean, materialize, parts, short_batches

#: Labelled rows that the model is fitted on at most, chosen by hash.
SAMPLE = 8000
#: Landmarks at most, and the strings that compete to be one.
LANDMARKS = 128
CANDIDATES = 1500
#: Toxic sample texts that a landmark must explain beyond those before it.
LEAST_SUPPORT = 3
#: Decay of a subsequence's weight per letter of span, and its widest span: at 7, two letters
#: put in anywhere leave every word of four letters or more above LEAST_MATCH.
DECAY, SPAN = 0.75, 7
#: A word matches a landmark from this share of the landmark's own kernel on.
LEAST_MATCH = 0.55
#: The power of the kernel beside the kernel itself.
POWER = 8
PREFIXES = range(4, 9)
KNOWN_WORDS = 200_000
#: How often disguised insults are repeated among the labelled texts.
TAUGHT = 1
LEAST_SHARE = 0.05
#: Letters of a word that are compared; longer ones are cut into such pieces.
PIECE = 48

# What stands for a letter in disguised words.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})

PATTERNS = sorted(((a, b) for b in range(2, SPAN) for a in range(1, b)), key=lambda p: p[1])
_SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")


def letters(word: str) -> str:
    """A word's letters, lower-case, disguises undone, others dropped."""
    w = word.lower()
    if not w.isalpha():
        w = "".join(c for c in w.translate(STANDS_FOR) if c.isalpha())
    return w


def words_of(text: str) -> set[str]:
    """The distinct words of a text, those spelt out letter by letter included."""
    found = set(text.split())
    for m in _SPACED.findall(text) if " " in text else ():
        found.add(m.replace(" ", ""))
    return found


def codes_of(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes (0: start of word, 1 to 26, 27 to 31 for others) of all
    strings in one array, and each code's string."""
    flat = np.frombuffer("".join("^" + s for s in strings).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    code = np.where(flat == 94, 0, np.where((flat >= 97) & (flat <= 122), flat - 96, 27 + flat % 5))
    return code, np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])


def subsequences(strings: list[str], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, subsequence, weight), one for each distinct subsequence of a
    string, with its densest occurrence's weight."""
    code, owner = codes_of(strings)
    keys, weights = [], []
    for a, b in PATTERNS:
        if len(code) <= b:
            continue
        n = len(code) - b
        seq = code[:n] << 10 | code[a : a + n] << 5 | code[b:]
        keep = owner[:n] == owner[b:]
        if useful is not None:
            keep &= useful[seq]
        at = np.flatnonzero(keep)
        keys.append(owner[at] << 15 | seq[at])
        weights.append(np.full(len(at), DECAY ** (b + 1)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, first = np.unique(np.concatenate(keys), return_index=True)  # denser patterns come first
    return key >> 15, key & 32767, np.concatenate(weights)[first]


class Matcher:
    """Kernel values of words against landmarks, as shares of each landmark's own."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.table = np.zeros((1 << 15, max(1, len(landmarks))), dtype=np.float32)
        owner, seq, weight = subsequences(landmarks)
        self.table[seq, owner] = weight
        self.own = np.maximum((self.table.astype(np.float64) ** 2).sum(axis=0), 1e-12)
        self.useful = self.table.any(axis=1)
        self.known: dict[str, tuple] = {}

    def kernel(self, strings: list[str]) -> np.ndarray:
        owner, seq, weight = subsequences(strings, self.useful)
        out = np.zeros((len(strings), self.table.shape[1]))
        if len(owner):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[starts]] = np.add.reduceat(self.table[seq] * weight[:, None], starts, axis=0)
        return out

    def learn(self, words: list[str]) -> None:
        pieces, of = [], []
        for i, w in enumerate(words):
            s = letters(w)
            for at in range(0, max(1, len(s) - 8), PIECE - 8):
                pieces.append(s[at : at + PIECE])
                of.append(i)
        hits: dict[int, list] = {}
        for at in range(0, len(pieces), 20_000):
            share = np.minimum(self.kernel(pieces[at : at + 20_000]) / self.own, 1.0)
            for p, j in zip(*np.nonzero(share >= LEAST_MATCH), strict=True):
                hits.setdefault(of[at + p], []).append((int(j), float(share[p, j])))
        self.known.update((w, tuple(hits.get(i, ()))) for i, w in enumerate(words))

    def describe(self, texts: list[str]) -> list[dict[int, float]]:
        """For each text, the best match of any of its words by landmark."""
        sets = [words_of(t) for t in texts]
        new = list(set().union(*sets).difference(self.known))
        self.learn(new)
        out = []
        for words in sets:
            best: dict[int, float] = {}
            for found in set(map(self.known.__getitem__, words)):
                for j, v in found:
                    if v > best.get(j, 0):
                        best[j] = v
            out.append(best)
        if len(self.known) > KNOWN_WORDS:
            for w in new:
                del self.known[w]
        return out


def candidates_of(text: str) -> set[str]:
    """The strings in a text that may become landmarks: words and their starts."""
    out = set()
    for w in words_of(text):
        s = letters(w)
        if 3 <= len(s) <= 2 * PIECE:
            out.update(s[:n] for n in PREFIXES if n < len(s))
            out.add(s)
    return out


def _count_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both, toxic = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = candidates_of(text or "")
            both.update(found)
            if label:
                toxic.update(found)
    names = list(both)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())], ["s", "n", "t"])


def choose_landmarks(sample: DataFrame, most: int = LANDMARKS) -> tuple[list[str], list[str]]:
    """Greedy cover: the string that explains most toxic texts, again and again.

    Clean texts count against it five-fold, texts that are explained already
    count a quarter, and no longer once three strings explain them.  Of
    strings that begin alike only the first is taken.
    """
    counts = sample.mapInArrow(_count_candidates, "s string, n long, t long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rate = F.col("t") / F.col("n")
    best = counts.where((F.col("t") >= LEAST_SUPPORT) & (rate >= 0.8)).orderBy((F.col("t") * rate * rate).desc(), F.length("s").desc(), "s").limit(CANDIDATES)
    names = [r.s for r in best.select("s").collect()]
    if not names:
        return [], []
    place = {s: i for i, s in enumerate(names)}

    def incidence(batches):
        for batch in batches:
            rows = [sorted(place[s] for s in candidates_of(t or "") if s in place) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], ["c", "toxic"])

    rows = sample.mapInArrow(incidence, "c array<int>, toxic int").where("size(c) > 0").collect()  # at most SAMPLE
    matrix = np.zeros((len(rows), len(names)), dtype=bool)
    for i, r in enumerate(rows):
        matrix[i, r.c] = True
    toxic = np.array([r.toxic == 1 for r in rows])
    matrix, against = matrix[toxic], 5 * matrix[~toxic].sum(axis=0)
    chosen = cover(names, matrix, against, most)
    support = matrix.sum(axis=0)
    return chosen, [s for s in chosen if not against[place[s]] and support[place[s]] >= LEAST_SHARE * len(matrix)]


def cover(names: list[str], matrix: np.ndarray, against: np.ndarray, most: int) -> list[str]:
    length, free = np.array([len(s) for s in names]), np.ones(len(names), dtype=bool)
    explained, chosen = np.zeros(len(matrix), dtype=np.int64), []
    while len(chosen) < most and len(matrix):
        worth = np.array([1.0, 0.25, 0.25, 0.0])[np.minimum(explained, 3)]
        gain = np.where(free, worth @ matrix - against, -1)
        top = gain.max()
        if top < LEAST_SUPPORT:
            break
        j = int(np.flatnonzero(gain == top)[np.argmax(length[gain == top])])
        chosen.append(names[j])
        explained += matrix[:, j]
        free &= np.array([not (s.startswith(names[j]) or names[j].startswith(s)) for s in names])
    return chosen


class ToxicityModel:
    """score = sigmoid(slope * (k . alpha + bias) + shift), k a text's matches
    and, after them, the matches to the POWER."""

    def __init__(self, landmarks: list[str], alpha: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.alpha, self.bias, self.slope, self.shift = landmarks, alpha, bias, slope, shift

    def scores(self, described: list[dict[int, float]]) -> list[float]:
        f = np.array([sum(self.alpha[j] * v + self.alpha[len(self.landmarks) + j] * v**POWER for j, v in sorted(d.items())) for d in described]) + self.bias
        return (1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -30, 30)))).tolist()


def disguised(s: str) -> list[str]:
    """A string, and it with one or two strange letters put in at inner places,
    and with each letter up to three times."""
    put = lambda t, at: t[:at] + "x" + t[at:]
    one = [put(s, i) for i in range(1, len(s))]
    two = [put(put(s, j), i) for j in range(1, len(s)) for i in range(1, j + 1)]
    repeated = [s[:i] + c * n + s[i:] for i, c in enumerate(s) for n in (1, 2)]
    return [s] * len(s) + one + two + repeated


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    inside = np.ones(len(x), dtype=bool)
    for _ in range(50):
        xs = x1[inside]
        w = np.linalg.solve(xs.T @ xs + ridge, xs.T @ y[inside])
        now = y * (x1 @ w) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return w[:-1], float(w[-1])


def fit_platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.column_stack([f, np.ones(len(f))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-6 * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled texts, none of them held out.

    A document counts once, as toxic if any of its labels says so; of rows that
    share its doc_id the last text in order teaches."""
    short_batches(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    )
    # Rows are at least as many as distinct documents, so about the sample is left to be sorted.
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(order < int(share * (1 << 32))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    texts = materialize(rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-sample")
    landmarks, pure = choose_landmarks(texts)

    def describe(batches):
        matcher = Matcher(landmarks)
        for batch in batches:
            for part in parts(batch, 0, 128):
                found = matcher.describe([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([list(d) for d in found], pa.list_(pa.int32())), pa.array([list(d.values()) for d in found], pa.list_(pa.float64())), part.column(1)], ["j", "v", "toxic"])

    rows = texts.mapInArrow(describe, "j array<int>, v array<double>, toxic int").collect()  # at most the sample
    discard(texts)
    y = np.array([1.0 if r.toxic else -1.0 for r in rows])
    if not landmarks or len(set(y)) < 2:
        rate = max((y > 0).sum() / (len(y) + 1), 1e-6)
        return ToxicityModel([], np.zeros(0), float(np.log(rate / (1 - rate))), 1.0, 0.0)
    k = np.zeros((len(rows), len(landmarks)))
    for i, r in enumerate(rows):
        k[i, r.j] = r.v
    matcher = Matcher(landmarks)
    scale = np.sqrt(matcher.own)
    between = np.clip(matcher.kernel(landmarks) / scale[:, None] / scale[None, :], 0, 1)
    root = np.zeros((2 * len(landmarks),) * 2)
    for at, m in ((0, between), (len(landmarks), between**POWER)):
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        root[at : at + len(landmarks), at : at + len(landmarks)] = vectors * (1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    # Insults that no clean text has also teach on their own, plain and disguised.
    taught = np.minimum(matcher.kernel([v for s in pure for v in disguised(s)] * TAUGHT) / matcher.own, 1.0)
    k, y = np.concatenate([k, np.where(taught >= LEAST_MATCH, taught, 0)]), np.concatenate([y, np.ones(len(taught))])
    k = np.column_stack([k, k**POWER])
    order = np.lexsort([*k.T, y])  # the same rows in any order give the same model
    x, y = (k @ root)[order], y[order]
    w, bias = fit_svm(x, y)
    slope, shift = fit_platt(x @ w + bias, y)
    return ToxicityModel(landmarks, root @ w, bias, slope, shift)


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score every whole text.

    Returns doc_id, held_out, score (0 to 1) and predicted, a row per row of
    ``docs``.  Labels, languages, sources and doc_ids are no inputs of a score,
    and held-out rows (crc32 of the doc_id as text divisible by 5) teach
    nothing.  Null counts as the empty text, which gets the score of a text
    without matches; a null doc_id is not held out; repeated rows score alike;
    without labels of both kinds all scores are the labels' rate.  Very long
    texts are scored whole, in time that grows with them.  An empty table gives
    no rows; other columns are not read.
    """
    model = fit_toxicity(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text")
    found = with_scores(rows, model, "score")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_scores(rows: DataFrame, model: ToxicityModel, name: str) -> DataFrame:
    """``rows`` with the score of their text in a further column."""
    place = rows.columns.index("text")
    short_batches(rows.sparkSession)

    @lean("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.landmarks)
        for batch in batches:
            score: list[float] = []
            for part in parts(batch, place, 128):
                score += model.scores(matcher.describe([t or "" for t in part.column(place).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted to be toxic.

    Null and empty texts have the score of a text without matches; a null
    doc_id changes nothing; repeated rows stay or go together; very long texts
    are scored whole; an empty table gives no rows; other columns, whatever
    their names, pass.  A score of 0.5 is toxic.
    """
    name = free_name(docs, "score")
    return with_scores(docs, fit_toxicity(docs, labels, sample), name).where(F.col(name) < 0.5).drop(name)
