"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier over
hashed character n-grams (logistic regression on square roots of relative
frequencies, so a text's length plays no part) predicts the bit of a text; the
language whose codeword loses least, with each bit's loss weighted by how well
the bit does on training texts left out of its fit, is the prediction.  With
few languages the code is exhaustive (every split of the languages in two); with
many it is the best of a few random codes by smallest distance of codewords.

The classifiers are fitted on a bounded sample of the labelled rows (see
``Training``), spread over the languages; prediction reads whole texts.

Defined results: null texts and texts without a letter are ``und`` with score
0; a tie goes to the smaller language name; every input row gives one output
row; null ids are kept; without labelled rows every text is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import prepare, stage, text_rows, texts

UNKNOWN = "und"
#: Hash buckets of n-grams of 1, 2 and 3 characters.
BUCKETS = 4096
#: Ideographs from here on are folded into a block of the table; none follows the last.
_TABLE = 0x20000
_LAST_LETTER = 0x323B0
_CHUNK = 400_000


@dataclass(frozen=True)
class Training:
    """``max_rows``: bound of the labelled sample, shared evenly by the
    languages, two rows each at least (of more than ``max_rows`` languages the
    most frequent are learnt); ``check_share``: its part on which the bits are
    weighed."""

    max_rows: int = 4000
    check_share: float = 0.2
    steps: int = 150
    rate: float = 4.0
    decay: float = 1e-5
    margin: float = 0.1


@dataclass
class Model:
    """``codes``: languages by bits, of +1 and -1; ``weights``: buckets by bits
    with ``bias``; ``trust``: weight of each bit's loss."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    margin: float

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each language (rows: texts).

        The loss of a bit is half the sum of its losses for either sign, less
        half the margin times the sign, so no table of texts by languages by bits
        is needed."""
        either = (np.logaddexp(0.0, -margins) + np.logaddexp(0.0, margins)) / 2
        return ((either @ self.trust)[:, None] - (margins * self.trust / 2) @ self.codes.T) / self.trust.sum()

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, probability and ambiguity of the nearest codeword."""
        losses = self.losses(margins)
        best = losses.argmin(axis=1)
        share = np.exp(-len(self.trust) * (losses - losses.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        top = share[np.arange(len(best)), best]
        second = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(best))
        return best, top, top - second < self.margin


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """+1/-1 codewords of ``n`` languages."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1 if lang == 0 or (split >> (lang - 1)) & 1 else -1 for lang in range(n)] for split in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), math.ceil(10 * math.log2(n))
    best, least = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        distance = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        balanced = (np.abs(code.sum(axis=0)) < n).all()
        if balanced and distance > least:
            best, least = code, distance
    return best


_CLASS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Per code point itself if a letter, a space if not (lower case is done before)."""
    global _CLASS
    if _CLASS is None:
        _CLASS = np.array([c if chr(c).isalpha() else 32 for c in range(_TABLE)], np.uint32)
    return _CLASS


def features(lines: list[str]) -> np.ndarray:
    """Rows of square roots of relative n-gram frequencies; zero without a letter."""
    counts = np.zeros((len(lines), BUCKETS), np.float32)
    at = 0
    while at < len(lines):
        held, size = [], 0
        while at + len(held) < len(lines) and size < _CHUNK:
            held.append(lines[at + len(held)].lower())
            size += len(held[-1]) + 2
        if len(held) == 1 and size > 4 * _CHUNK:  # one very long text: piece by piece, with the overlap of a trigram
            text = held[0]
            for cut in range(0, len(text), _CHUNK):
                counts[at] += _counts([text[max(0, cut - 2) : cut + _CHUNK]])[0]
        else:
            counts[at : at + len(held)] = _counts(held)
        at += len(held)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def _counts(lines: list[str]) -> np.ndarray:
    joined = "\n\n".join(lines) + "\n\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 2 for t in lines])
    row = np.repeat(np.arange(len(lines), dtype=np.int64), lengths)
    table = _letters()
    beyond = np.where(points < _LAST_LETTER, 0x4E00 + points % 0x1000, 32)
    points = table[np.where(points < _TABLE, points, beyond)]
    # one space between words, so signs and digits leave no trace
    keep = np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])
    points, row = points[keep], row[keep]
    if not len(points):
        return np.zeros((len(lines), BUCKETS), np.float32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    one = points * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + points[1:] * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + points[2:] * np.uint32(0x2545F491)
    out = np.zeros(len(lines) * BUCKETS, np.float32)
    letter = points != 32
    for n, hashed, some in ((1, one, letter), (2, two, letter[:-1] | letter[1:]), (3, three, letter[1:-1] | letter[:-2] | letter[2:])):
        same = row[: len(hashed)] == row[n - 1 :]
        some = some & same
        slot = row[: len(hashed)][some] * BUCKETS + (hashed[some] >> shift)
        out += np.bincount(slot, minlength=len(out)).astype(np.float32)
    return out.reshape(len(lines), BUCKETS)


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", usable: Column | None = None,
          params: Training = Training()) -> Model | None:
    """Fit on the rows that ``usable`` (a condition on ``doc_id``) admits and
    whose label is not null; None if there is none."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col, label=F.col(label_col).cast("string")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    marks = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(params.max_rows).collect()
    languages = sorted(r["label"] for r in marks)
    if not languages:
        return None
    each = max(2, params.max_rows // len(languages))
    # the smallest hashes of each language; ids only, so ranking them moves no text
    order = F.xxhash64("doc_id", F.lit(11))
    share = docs.sparkSession.createDataFrame([(r["label"], min(1.0, 2.0 * each / r["count"])) for r in marks], "label string, share double")
    # at most max_rows labels: the bound of this broadcast
    near = rows.select("doc_id", "label").join(F.broadcast(share), "label").where(F.pmod(order, F.lit(1_000_000)) < F.col("share") * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order, "doc_id"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", F.col("label").alias("chosen")).distinct()
    # at most max_rows ids and labels: the bound of this broadcast
    sample = stage(rows.join(F.broadcast(chosen), "doc_id").where("label = chosen").select("doc_id", "label", "text"), "lang-sample")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, lines in text_rows(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "x": [v.astype("<f2").tobytes() for v in features(lines)]})

    found = sample.mapInPandas(run, "doc_id long, label string, x binary").toPandas().sort_values(["doc_id", "label"])
    found = found.iloc[: 2 * params.max_rows]
    x = np.stack([np.frombuffer(v, "<f2") for v in found["x"]]).astype(np.float32)
    some = x.any(axis=1)
    return fit(x[some], found["label"].to_numpy()[some], languages, params)


def fit(x: np.ndarray, labels: np.ndarray, languages: list[str], params: Training = Training()) -> Model | None:
    if not len(x):
        return None
    codes = codewords(len(languages))
    target = codes[np.searchsorted(languages, labels)].astype(np.float32)
    check = np.random.default_rng(3).random(len(x)) < params.check_share
    if check.all() or not check.any():
        check = np.arange(len(x)) % 5 == 0
    learn = ~check if (~check).any() else check
    weights, bias = _logistic(x[learn], target[learn], params)
    right = ((x[check] @ weights + bias) * target[check] > 0).mean(axis=0)
    # log odds of a bit being right, as boosting weighs its parts
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    return Model(languages, codes, weights, bias, trust, params.margin)


def _logistic(x: np.ndarray, target: np.ndarray, params: Training) -> tuple[np.ndarray, np.ndarray]:
    """Gradient descent with momentum for all bits at once."""
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    step_w, step_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(params.steps):
        pull = target / (1 + np.exp(target * (x @ w + b))) / len(x)
        step_w = 0.9 * step_w + x.T @ pull - params.decay * w
        step_b = 0.9 * step_b + pull.sum(axis=0)
        w, b = w + params.rate * step_w, b + params.rate * step_b
    return w, b


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` of every row."""
    prepare(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, lines in text_rows(frames):
            names, scores, unsure = [], [], []
            for at in range(0, len(lines), 250):
                x = features(lines[at : at + 250])
                some = x.any(axis=1)
                if model is None:
                    some[:] = False
                    best, top, close = np.zeros(len(x), int), np.zeros(len(x)), np.ones(len(x), bool)
                else:
                    best, top, close = model.decode(x @ model.weights + model.bias)
                names += [model.languages[i] if s else UNKNOWN for i, s in zip(best, some)]
                scores += np.where(some, top, 0.0).astype(float).tolist()
                unsure += (close | ~some).tolist()
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": names, "score": scores, "ambiguous": unsure})

    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
