"""Personal data: pattern spans, and terms that disclose them.

Emails, addresses, card and phone numbers are found by pattern.  Their values
are the protected entities, and so are the parts of a value that others share:
mail domains, networks, card issuers, the beginnings of phone numbers.  Corpus
co-occurrence then tells how strongly a term (a word or number outside those
spans) reveals an entity.  With p(e) the share of texts that hold ``e``,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(p(e | t) / p(e)) / log(1 / p(e))

which nears 1 when the term never occurs without the entity and is 0 when the
two are independent.  p(e | t) is not taken from the counts as it is: a term
counts as disclosing to degree ``d`` only if ``n_both`` of ``n_term`` documents rule out
that p(e | t) is p(e) ^ (1 - d) or less,

    n_term * KL(n_both / n_term, p(e) ^ (1 - d)) >= log(pairs / alpha)

(Chernoff's bound), where ``pairs`` is the number of entities times that of terms
in the corpus.  So among all pairs less than ``alpha`` pass by chance, at any size of
the corpus: words that met an entity once or twice disclose nothing.  From
``generalise_at`` a term becomes a span ``generalise``, from ``remove_at`` a span
``remove``, at every place of every document that holds the entity.

All counts cover every document and the whole of it.  A text that is repeated is
evidence once (its copies do count in ``n_term``).  The test's own limits say which
pairs need counting: an entity in too few texts passes with no term, and a term can
pass with an entity only if it stands in enough documents for the evidence and in
not many more than the entity.

Defined results: null texts are empty and have no spans; texts of any length are
read whole; every input row gives one output row, repeated rows the same one;
null ids are kept; near two entities the stronger action holds; without entities
there are no spans, and an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import prepare, stage, text_rows, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "generalise", "remove")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits whose own start failed, so the
# look-behind only saves time on very long runs
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


@dataclass(frozen=True)
class Disclosure:
    """``alpha``: the number of pairs that may pass by chance in a whole corpus."""

    alpha: float = 0.01
    generalise_at: float = 0.6
    remove_at: float = 0.9


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            free = match.end()
        at = text.find("@", match.end() if match else at + 1)
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern spans, by kind as listed, then start."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity_value(kind: str, value: str) -> str:
    """Spellings of one value meet: case of emails and marks in numbers go."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def entities(kind: str, value: str) -> list[str]:
    """The entity of a value, then those of the parts that other values may share."""
    whole = entity_value(kind, value)
    plain = whole.partition(":")[2]
    if kind == "email":
        labels = plain.rpartition("@")[2].split(".")
        parts = [".".join(labels[i:]) for i in range(len(labels) - 1)]
    elif kind == "ip":
        numbers = plain.split(".")
        parts = [".".join(numbers[:n]) for n in (3, 2)]
    elif kind == "card":
        parts = [plain[:6]]
    else:
        parts = [plain[:-n] for n in (4, 7) if len(plain) > n]
    return [whole, *(f"{kind} part:{p}" for p in parts)]


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(hash, start, end) of each word or number that no span touches."""
    taken = sorted((a, b) for _, a, b in spans)
    i, reach = 0, 0
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][1])
            i += 1
        if m.start() >= reach:
            yield _hash(m.group().lower()), m.start(), m.end()


_SPANS = "array<struct<kind string, start long, end long>>"
_WORDS = "array<struct<term long, start long, end long>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Disclosure = Disclosure()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``row_key`` (a hash of id and
    text), ``base`` and ``terms`` (arrays of kind, start, end in code points,
    end exclusive) and ``base_sha256``."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("text_key", F.xxhash64("text"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, lines in text_rows(frames):
            spans = [base_spans(t) for t in lines]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "row_key": frame["row_key"], "text_key": frame["text_key"],
                "base": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans],
                "base_sha256": [hashlib.sha256(span_text(s).encode()).hexdigest() for s in spans],
                "entities": [list({_hash(e) for k, a, b in s for e in entities(k, t[a:b])}) for t, s in zip(lines, spans)],
                "words": [[{"term": w, "start": a, "end": b} for w, a, b in terms(t, s)] if s else [] for t, s in zip(lines, spans)],
            })

    schema = f"doc_id long, row_key long, text_key long, base {_SPANS}, base_sha256 string, entities array<long>, words {_WORDS}"
    found = stage(rows.mapInPandas(scan, schema), "pii-spans")
    marks = _disclosing(rows, found, params)
    if marks is None:
        return found.select("doc_id", "row_key", "base", F.array().cast(_SPANS).alias("terms"), "base_sha256")
    return found.join(marks, "row_key", "left").select(
        "doc_id", "row_key", "base", F.coalesce("terms", F.array().cast(_SPANS)).alias("terms"), "base_sha256")


def _frequency(rows: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for _, lines in text_rows(frames):
            for text in lines:
                counts.update({w.lower() for w in set(_WORD.findall(text))})
                if len(counts) > 400_000:  # bounds the worker's memory; Spark adds the parts up
                    yield pd.DataFrame({"term": [_hash(w) for w in counts], "n": list(counts.values())})
                    counts.clear()
        yield pd.DataFrame({"term": [_hash(w) for w in counts], "n": list(counts.values())})

    return rows.mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def passes(n_both: Column, n_term: Column, share: Column, degree: float, evidence: float) -> Column:
    """Whether the counts rule out that p(e | t) <= p(e) ^ (1 - degree)."""
    p, q = F.pow(share, F.lit(1 - degree)), n_both / n_term
    kl = q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return (share < 1) & (q > p) & (n_term * kl >= evidence)


def _disclosing(rows: DataFrame, found: DataFrame, params: Disclosure) -> DataFrame | None:
    """(row_key, terms): the spans of terms that disclose an entity of their
    document; None where no entity can pass the test."""
    held = found.where(F.size("entities") > 0)
    per_entity = stage(held.select("text_key", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity")), "pii-entities")
    total, n_entities = found.select(F.countDistinct("text_key")).first()[0], per_entity.count()
    if not n_entities:
        return None
    share = F.col("n_entity") / F.lit(float(total))
    # the most evidence there can be: every text of the entity, and no other, holds the term
    most = F.col("n_entity") * (1 - params.generalise_at) * -F.log(share)
    if per_entity.where(most >= math.log(n_entities / params.alpha)).isEmpty():  # however few the terms
        return None
    frequency = stage(_frequency(rows), "pii-frequency")
    evidence = math.log(n_entities * max(1, frequency.count()) / params.alpha)
    able = per_entity.where(most >= evidence)
    if able.isEmpty():
        return None
    least = F.pow(share, F.lit(1 - params.generalise_at))  # the smallest p(e | t) of a disclosing term
    able = able.select("entity", "n_entity", (F.lit(evidence) / -F.log(least)).alias("fewest"), (F.col("n_entity") / least).alias("below"))
    fewest, below = able.agg(F.min("fewest"), F.max("below")).first()
    some_terms = frequency.where(F.col("n_term").between(math.floor(fewest), math.ceil(below)))
    own = held.dropDuplicates(["row_key"])
    its_terms = own.select("row_key", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    its_entities = own.select("row_key", "text_key", F.explode("entities").alias("entity")).join(able, "entity")
    fits = (F.col("n_term") >= F.col("fewest") - 1e-6) & (F.col("n_term") < F.col("below") + 1e-6)
    pairs = stage(its_terms.join(some_terms, "term").join(its_entities, "row_key").where(fits).select("row_key", "text_key", "entity", "term", "n_entity", "n_term"), "pii-pairs")
    once = own.groupBy("text_key").agg(F.min("row_key").alias("row_key")).select("row_key")
    both = pairs.join(once, "row_key", "left_semi").groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both"))
    test = lambda degree: passes(F.col("n_both"), F.col("n_term"), share, degree, evidence)
    judged = both.where(test(params.generalise_at)).select("entity", "term", F.when(test(params.remove_at), "remove").otherwise("generalise").alias("kind"))
    hits = pairs.join(judged, ["entity", "term"]).groupBy("row_key", "term").agg(F.max("kind").alias("kind"))
    places = own.select("row_key", F.explode("words").alias("w")).select("row_key", "w.*").join(hits, ["row_key", "term"])
    return places.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, text) with spans replaced: base kinds and generalised terms by
    their kind in brackets, removed terms by nothing.  A null text stays null."""
    spans = find(docs, id_col, text_col, params)
    spans = spans.groupBy("row_key").agg(F.first(F.concat("base", "terms")).alias("spans"))  # repeated rows have the same

    @F.pandas_udf("string")
    def replace(column: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([redact(t, [(s["kind"], s["start"], s["end"]) for s in ss]) if isinstance(t, str) else None for t, ss in zip(column, spans)])

    rows = texts(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text"))
    return rows.join(spans, "row_key").select("doc_id", replace("text", "spans").alias("text"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:  # inside a span that is replaced already
            at = max(at, end)
            continue
        out += [text[at:start], "" if kind == "remove" else f"[{kind.upper()}]" if kind != "generalise" else "[TERM]"]
        at = end
    return "".join([*out, text[at:]])
