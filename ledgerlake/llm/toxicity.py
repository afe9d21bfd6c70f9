"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Texts are folded first: compatibility forms, accents, look-alike letters of
other scripts and digits or signs written for letters all become plain
letters.  One automaton finds whole words, word beginnings and exception
phrases; a word counts with its heaviest entry unless an exception phrase
covers it.  The weights' sum, normalised by the text's length, is turned into
a probability by a monotone calibration.

The lexicon, its weights, the exception phrases and the calibration are
learned from labelled rows (a bounded sample; see ``LexiconParams``).

Defined results: null and empty texts match nothing and get the calibrated
score of a text without matches; every input row gives one output row (so
repeated rows are repeated); a null id is scored like any other; with no
labelled row the lexicon is empty and every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import prepare, stage, text_rows, texts

# Letters of other scripts that look like Latin ones, and signs
# written for letters.  l, 1, | and ! all become i, so each spelling meets.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "i", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y",
    "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_LOOKALIKE_TABLE = str.maketrans(LOOKALIKES)
_SIGN_TABLE = str.maketrans(SIGNS)
_WITH_SIGN = re.compile(r"(?<!\S)[^\s0-9@$!|]*+[0-9@$!|]\S*+")
# marks around a word that stand for no letter there: ! and | are letters inside a
# word only, and three @ or $ in a row are decoration
_EDGES = re.compile(r"^(?:[^\w@$]|[@$]{3,})+|(?:[^\w@$]|[@$]{3,})+$")
_LETTER = re.compile(r"[^\W\d_]")
_BETWEEN = re.compile(r"[\W\d_]+")


def _letters_for_signs(match: re.Match) -> str:
    word = match.group()
    if not _LETTER.search(word):
        return word
    inner = _EDGES.sub("", word)
    return f" {inner.translate(_SIGN_TABLE)} "


def fold(text: str) -> str:
    """Folded words with one space before, between and after them."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower()
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
        text = text.translate(_LOOKALIKE_TABLE)
    text = _WITH_SIGN.sub(_letters_for_signs, text).replace("l", "i")
    return f" {_BETWEEN.sub(' ', text).strip()} "


@dataclass(frozen=True)
class LexiconParams:
    """``max_train``: bound of the labelled sample, chosen by a hash of the id.
    ``min_evidence``: least log-likelihood ratio of an entry.  ``cover``: entries
    that a toxic text needs before it stops calling for more.  ``max_entries``,
    ``max_exceptions``: bounds of the lexicon.  ``prefix``: lengths of word
    beginnings that can be entries."""

    max_train: int = 8000
    min_evidence: float = 18.0
    min_odds: float = 8.0
    max_candidates: int = 4000
    max_entries: int = 400
    max_exceptions: int = 200
    cover: int = 3
    prefix: tuple[int, ...] = (4, 5, 6, 7)


@dataclass
class Lexicon:
    """``words``: patterns (a leading space, and a trailing one for whole
    words) with weights; ``exceptions``: phrases of folded words; ``steps``:
    calibration as (least density, probability), ascending."""

    words: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    steps: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0)])

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, weight in self.words.items():
            machine.add_word(pattern, (len(pattern), weight, False))
        for phrase in self.exceptions:
            pattern = f" {phrase} "
            machine.add_word(pattern, (len(pattern), 0.0, True))
        if len(machine):
            machine.make_automaton()
        return machine

    def probability(self, density: float) -> float:
        return self.steps[max(0, bisect_right(self.steps, (density, math.inf)) - 1)][1]


def matches(machine, folded: str) -> list[tuple[int, float]]:
    """(start, weight) of each matched word outside exception phrases."""
    if not len(machine):
        return []
    best: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (length, weight, exception) in machine.iter(folded):
        start = end - length + 1
        if exception:
            covered.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if covered:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in covered)}
    return sorted(best.items())


def density(machine, folded: str) -> float:
    """Sum of weights over the root of the number of words (10 at least)."""
    total = sum(w for _, w in matches(machine, folded))
    return total / math.sqrt(max(10, folded.count(" ") - 1)) if total else 0.0


def _entries(folded: str, lengths: tuple[int, ...]) -> set[str]:
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for n in lengths:
        found.update(f" {w[:n]}" for w in words if len(w) >= n)
    return found


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          usable: Column | None = None, params: LexiconParams = LexiconParams()) -> Lexicon:
    """Learn the lexicon from the labelled rows that ``usable`` (a condition on
    ``doc_id``) admits.  Entries are taken greedily: each must explain toxic
    texts that earlier entries do not, so words that merely repeat in copies of
    one text are left out."""
    prepare(docs.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if usable is not None:
        marks = marks.where(usable)
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = marks.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(params.max_train)
    # at most max_train rows of two numbers: the bound of this broadcast
    sample = stage(texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id"), "toxicity-sample")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for frame, rows in text_rows(frames):
            for text, label in zip(rows, frame["label"]):
                (toxic if label else clean).update(_entries(fold(text), params.prefix))
        entries = list(toxic | clean)
        if entries:
            yield pd.DataFrame({"entry": entries, "n_toxic": [toxic[e] for e in entries], "n_clean": [clean[e] for e in entries]})

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    counts = sample.mapInPandas(count, "entry string, n_toxic long, n_clean long")
    counts = counts.groupBy("entry").agg(F.sum("n_toxic").alias("a"), F.sum("n_clean").alias("b"))
    base = n_toxic / (n_toxic + n_clean)
    rate = F.col("a") / (F.col("a") + F.col("b"))
    evidence = 2 * (F.col("a") * F.log(rate / base) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - rate) / (1 - base))).otherwise(0))
    odds = ((F.col("a") + 0.5) / (n_toxic + 1)) / ((F.col("b") + 0.5) / (n_clean + 1))
    candidates = {
        r["entry"]: (r["a"], r["b"], math.log(r["odds"]))
        for r in counts.where(F.col("a") > 0).withColumns({"evidence": evidence, "odds": odds})
        .where((F.col("evidence") >= params.min_evidence) & (F.col("odds") >= params.min_odds) & (rate > 0.5))
        .orderBy(F.desc("evidence"), "entry").limit(params.max_candidates).collect()
    }

    def incidence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, rows in text_rows(frames):
            hits = [sorted(_entries(fold(t), params.prefix) & candidates.keys()) if label else [] for t, label in zip(rows, frame["label"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "hits": hits})

    # the sample is bounded, so what its toxic texts contain is too
    found = sample.where("label = 1").mapInPandas(incidence, "doc_id long, hits array<string>").collect()
    words = _explain([set(r["hits"]) for r in sorted(found, key=lambda r: r["doc_id"])], candidates, params)
    lexicon = Lexicon(words)
    lexicon.exceptions = _exceptions(sample, lexicon, params)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for frame, rows in text_rows(frames):
            yield pd.DataFrame({"x": [density(machine, fold(t)) for t in rows], "label": frame["label"]})

    points = [(r["x"], r["label"]) for r in sample.mapInPandas(measure, "x double, label int").collect()]
    lexicon.steps = monotone(points)
    return lexicon


def _explain(docs: list[set[str]], candidates: dict[str, tuple], params: LexiconParams) -> dict[str, float]:
    """Greedy cover: each step takes the entry found in most toxic texts that
    have fewer than ``cover`` entries yet, net of the clean texts it hits (ties:
    the longer, then the greater entry).  Entries that extend or begin a taken
    one are passed over."""
    members: dict[str, set[int]] = {}
    for i, hits in enumerate(docs):
        for entry in hits:
            members.setdefault(entry, set()).add(i)
    open_docs, times, words = set(range(len(docs))), Counter(), {}
    least = max(3, math.ceil(0.005 * len(docs)))
    while members and len(words) < params.max_entries:
        gain = {e: len(m & open_docs) - 2 * candidates[e][1] for e, m in members.items()}
        entry = max(gain, key=lambda e: (gain[e], len(e), e))
        if gain[entry] < least:
            break
        words[entry] = candidates[entry][2]
        times.update(members[entry])
        open_docs -= {i for i in members[entry] if times[i] >= params.cover}
        members = {e: m for e, m in members.items() if not (e.startswith(entry) or entry.startswith(e))}
    return words


def _exceptions(sample: DataFrame, lexicon: Lexicon, params: LexiconParams) -> list[str]:
    """Word pairs around a match that occur in clean texts only, five times at least."""

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        counts: Counter = Counter()
        for frame, rows in text_rows(frames):
            for text, label in zip(rows, frame["label"]):
                folded = fold(text)
                seen = set()
                for start, _ in matches(machine, folded):
                    around = folded[:start].split()[-1:] + folded[start:].split(maxsplit=2)[:2]
                    seen.update(" ".join(around[i : i + 2]) for i in range(len(around) - 1))
                counts.update((p, int(label)) for p in seen)
        keys = list(counts)
        if keys:
            yield pd.DataFrame({"phrase": [k[0] for k in keys], "label": [k[1] for k in keys], "n": [counts[k] for k in keys]})

    found = sample.mapInPandas(pairs, "phrase string, label int, n long").groupBy("phrase").agg(
        F.sum(F.col("n") * F.col("label")).alias("a"), F.sum(F.col("n") * (1 - F.col("label"))).alias("b"))
    kept = found.where("a = 0 and b >= 5").orderBy(F.desc("b"), "phrase").limit(params.max_exceptions)
    return [r["phrase"] for r in kept.collect()]


def monotone(points: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """Non-decreasing step fit (pool adjacent violators) of labels on densities."""
    blocks: list[list[float]] = []
    for x, y in sorted(points):
        if blocks and blocks[-1][0] == x:
            blocks[-1][1] += y
            blocks[-1][2] += 1
        else:
            blocks.append([x, y, 1])
    merged: list[list[float]] = []
    for block in blocks:
        merged.append(block)
        while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
            _, y, n = merged.pop()
            merged[-1][1] += y
            merged[-1][2] += n
    return [(x, (y + 0.01) / (n + 0.02)) for x, y, n in merged] or [(0.0, 0.0)]


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
          **carried: Column) -> DataFrame:
    """Every row of ``docs`` with ``score``, ``predicted``, ``density`` and
    ``n_matches``; ``carried`` are further columns to keep, by name."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col, **carried)
    kept = [f"{n} {t}" for n, t in rows.dtypes if n != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for frame, lines in text_rows(frames):
            folded = [fold(t) for t in lines]
            dense = [density(machine, f) for f in folded]
            out = frame.drop(columns="text")
            out["score"] = [lexicon.probability(d) for d in dense]
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            out["density"] = dense
            out["n_matches"] = [len(matches(machine, f)) if d else 0 for f, d in zip(folded, dense)]
            yield out

    return rows.mapInPandas(run, ", ".join([*kept, "score double", "predicted int", "density double", "n_matches int"]))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``threshold``."""
    prepare(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(column: pd.Series) -> pd.Series:
        machine = lexicon.automaton()
        return pd.Series([lexicon.probability(density(machine, fold(t if isinstance(t, str) else ""))) < threshold for t in column])

    return docs.where(clean(F.col(text_col).cast("string")))
