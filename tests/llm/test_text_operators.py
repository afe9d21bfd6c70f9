"""Language id, toxicity, personal data, licences: rules, hand-made cases, accuracy."""

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import lang_id, license_scan, license_texts, pii, queries, toxicity

SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, row_key string, label int, __n int"


def clashing(spark, rows):
    """Rows (doc_id, text) in a frame with extra columns that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)


EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (4, "word"), (None, "word"), (5, "ab " * 200_000)]


# --- language id -------------------------------------------------------------

def test_codewords_are_distinct_and_far_apart():
    for n in (1, 2, 4, 6, 9, 40):
        code = lang_id.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code}) == n
    code = lang_id.codewords(4)
    distance = (code.shape[1] - code @ code.T) / 2
    assert distance[~np.eye(4, dtype=bool)].min() == 4  # corrects one wrong bit


def test_one_wrong_bit_is_corrected_and_ambiguity_flagged():
    code = lang_id.codewords(4)
    model = lang_id.Model(list("abcd"), code, np.zeros((1, 7)), np.zeros(7), np.ones(7), 0.1)
    margins = 3 * code.copy()
    for bit in range(7):
        flipped = margins.copy()
        flipped[:, bit] *= -1
        assert model.decode(flipped)[0].tolist() == [0, 1, 2, 3]
    assert model.decode(np.zeros((1, 7)))[2].tolist() == [True]


def test_features_count_letters_only():
    x = lang_id.features(["Ab, ab! 12", "ab ab", "12 !", ""])
    assert np.allclose(x[0], x[1]) and x[0].any()
    assert not x[2].any() and not x[3].any()


def test_language_of_whole_texts_held_out(spark):
    found = queries.op1_language_id(spark, SF01).join(queries.table(spark, SF01, "documents").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_loss_of_a_bit_by_either_sign():
    rng = np.random.default_rng(4)
    codes = lang_id.codewords(9)
    model = lang_id.Model([str(i) for i in range(9)], codes, np.zeros((1, 1)), np.zeros(1), rng.random(codes.shape[1]) + 0.1, 0.1)
    margins = rng.normal(scale=5, size=(20, codes.shape[1]))
    each = np.logaddexp(0.0, -margins[:, None, :] * codes[None, :, :])
    assert np.allclose(model.losses(margins), (each * model.trust).sum(axis=2) / model.trust.sum())


def test_five_hundred_languages_are_learnt(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    words = {f"l{i:03}": [word() for _ in range(12)] for i in range(500)}
    rows = [(n * 10 + k, " ".join(rng.choices(w, k=40)), name) for n, (name, w) in enumerate(words.items()) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = lang_id.train(docs, usable=F.col("doc_id") % 10 != 5)
    assert model.languages == sorted(words)
    found = lang_id.predict(docs, model).where("doc_id % 10 = 5").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9


def test_language_edge_cases(spark):
    learn = spark.createDataFrame([(i, "der die das und ist nicht" if i % 2 else "the and that with this", "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    model = lang_id.train(learn)
    rows = lang_id.predict(clashing(spark, EDGE + [(6, "𝟙 🙂 123"), (7, "das und die")]), model).collect()
    assert len(rows) == len(EDGE) + 2
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 6))
    assert got[7]["lang_pred"] == "de" and got[7]["score"] > 0.5
    assert lang_id.train(learn.where("false")) is None
    assert lang_id.predict(learn, None).select("lang_pred").distinct().collect()[0][0] == "und"
    assert lang_id.predict(learn.where("false"), model).count() == 0


# --- toxicity ----------------------------------------------------------------

@pytest.mark.parametrize("text, folded", [
    ("You IDIOT!", " you idiot "), ("1d10t", " idiot "), ("іdіоt", " idiot "), ("idıot", " idiot "), ("ｉｄｉｏｔ", " idiot "),
    ("ídiòt", " idiot "), ("moron$$$ x", " moron x "), ("l0ser", " ioser "), ("call 555 now", " caii now "), ("", "  "), ("a$$hat", " asshat "),
    ("$tupid", " stupid "), ("a$$", " ass "), ("(@bc)", " abc "), ("$$$moron", " moron "), ("1$ @ $", "  "),
])
def test_fold(text, folded):
    assert toxicity.fold(text) == folded


def test_longest_weight_counts_once_and_exceptions_cover():
    lexicon = toxicity.Lexicon({" ciown ": 3.0, " cio": 1.0}, ["ciown fish"], [(0.0, 0.1), (0.5, 0.9)])
    machine = lexicon.automaton()
    assert [w for _, w in toxicity.matches(machine, toxicity.fold("a clown, a clone"))] == [3.0, 1.0]
    assert toxicity.matches(machine, toxicity.fold("the clown fish")) == []
    assert toxicity.density(machine, toxicity.fold("")) == 0.0
    assert lexicon.probability(0.0) == 0.1 and lexicon.probability(7.0) == 0.9


def test_monotone_fit():
    steps = toxicity.monotone([(0, 0), (0, 0), (1, 1), (2, 0), (3, 1), (4, 1)])
    values = [v for _, v in steps]
    assert values == sorted(values) and steps[0][0] == 0
    assert toxicity.monotone([]) == [(0.0, 0.0)]


def test_toxicity_learned_exceptions_and_copies(spark):
    rows = [(i, f"you are a clown indeed w{i}" if i % 4 == 0 else f"a clown fish swims w{i}" if i % 4 == 1 else f"plain words here w{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, lexicon).collect()}
    assert got == {i: int(i % 4 == 0) for i, _ in rows}


def test_toxicity_held_out_and_filter_agree(spark):
    labels = queries.table(spark, SF01, "labels").select("doc_id", "toxic")
    found = queries.op7_toxicity(spark, SF01).cache()
    wrong = found.join(labels, "doc_id").where("predicted = 1 and toxic = 0").count()
    assert wrong == 0
    caught = found.join(labels.where("toxic = 1"), "doc_id").agg(F.avg("predicted")).first()[0]
    assert caught > 0.5  # 37 toxic texts to learn from
    assert found.where("predicted <> (score >= 0.3)::int").count() == 0


def test_toxicity_edge_cases(spark):
    lexicon = toxicity.Lexicon({" word ": 4.0}, [], [(0.0, 0.05), (0.5, 0.99)])
    rows = toxicity.score(clashing(spark, EDGE), lexicon).collect()
    assert len(rows) == len(EDGE)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["doc_id"] for r in rows if r["predicted"]} == {4, None}
    kept = toxicity.drop_toxic(clashing(spark, EDGE), lexicon)
    assert kept.columns == ["doc_id", "text", "row_key", "label", "__n"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5]
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(clashing(spark, EDGE), empty).words == {}


# --- personal data -----------------------------------------------------------

def plain_spans(text):
    """The base patterns as written down, each by itself."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(5)
    alphabet = list("aZ0123459.@+-% ()é\n") + ["1.2.3.4", "4539578763621486", "+44 20 7946 0958", "a.b@c.de", "@x.y", "300.1.1.1", "²"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_stay_cheap():
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]


def direct_terms(rows, params=pii.Disclosure()):
    """(doc_id, start, end, kind) of the disclosing terms, by counting all pairs."""
    spans = {i: pii.base_spans(t) for i, t in rows}
    held = {i: {e for k, a, b in spans[i] for e in pii.entities(k, t[a:b])} for i, t in rows}
    place = {i: [(w.group().lower(), w.start(), w.end()) for w in re.finditer(r"[^\W_]+", t) if not any(a < w.end() and w.start() < b for _, a, b in spans[i])] for i, t in rows}
    one_of = {t: i for i, t in rows}  # a repeated text is evidence once
    n_term = Counter(w for i, t in rows for w in {m.lower() for m in re.findall(r"[^\W_]+", t)})
    n_entity = Counter(e for i in one_of.values() for e in held[i])
    n_both = Counter((e, w) for i in one_of.values() for e in held[i] for w in {p[0] for p in place[i]})
    evidence = math.log(len(n_entity) * len(n_term) / params.alpha)

    def kind(e, w):
        share, q = n_entity[e] / len(one_of), n_both[e, w] / n_term[w]
        for degree, name in ((params.remove_at, "remove"), (params.generalise_at, "generalise")):
            p = share ** (1 - degree)
            if share < 1 and q > p and n_term[w] * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)) >= evidence:
                return name
        return ""

    out = set()
    for i, _ in rows:
        for w, a, b in place[i]:
            best = max((kind(e, w) for e in held[i]), default="")
            if best:
                out.add((i, a, b, best))
    return out


def corpus_with_entities(shuffled=False, n=1500):
    """Documents of common words; bob's mail comes with its own words, most mails
    of a domain with one word, and single mails with nothing that tells."""
    rng = random.Random(3)
    common = [f"word{i}" for i in range(150)] + ["to", "42"]
    texts, mails = [], []
    for i in range(n):
        words = rng.choices(common, k=30)
        mail = ""
        if i % 25 == 0:
            mail = "bob@site.org"
            words += ["mail", "zanzibar", "x7"] + rng.choices(common, k=60) + ["zanzibar"]
        elif i % 25 == 1:
            mail = f"p{i}@zoo.example"
            words[3:3] = ["quokka"] if i % 4 else []
        elif i % 50 == 2:
            mail = f"u{i}@h{i}.example"
            words.append(f"rare{i}")
        texts.append(words)
        mails.append(mail)
    if shuffled:
        rng.shuffle(mails)
    rows = [(i, f"{mails[i]} {' '.join(w)}".strip()) for i, w in enumerate(texts)]
    return rows + [(n + k, rows[2][1]) for k in range(40)]  # copies of one text with a mail of its own


def test_disclosing_terms_by_counting_all_pairs(spark):
    rows = corpus_with_entities()
    found = pii.find(clashing(spark, rows)).collect()
    got = {(r["doc_id"], t["start"], t["end"], t["kind"]) for r in found for t in r["terms"]}
    assert got == direct_terms(rows)
    text = dict(rows)
    words = {(text[i][a:b], kind) for i, a, b, kind in got}
    assert ("zanzibar", "remove") in words and ("x7", "remove") in words and any(w == "quokka" for w, _ in words)
    assert {w for w, _ in words} <= {"zanzibar", "x7", "mail", "quokka"}
    # at every place of the document, however far from the entity
    assert sum(text[i][a:b] == "zanzibar" for i, a, b, _ in got if i == 0) == 2
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(clashing(spark, rows)).collect()}
    assert "zanzibar" not in out[0] and "[EMAIL]" in out[0] and "rare2" in out[2]


def test_entities_dealt_out_at_random_disclose_nothing(spark):
    assert len(direct_terms(corpus_with_entities())) > 100
    shuffled = pii.find(clashing(spark, corpus_with_entities(shuffled=True))).collect()
    assert sum(len(r["terms"]) for r in shuffled) == 0


def test_shared_parts_of_values():
    assert pii.entities("email", "A.b@x.site.org") == ["email:a.b@x.site.org", "email part:x.site.org", "email part:site.org"]
    assert pii.entities("phone", "+1 (017) 555-7713") == ["phone:10175557713", "phone part:1017555", "phone part:1017"]


def test_share_of_documents_with_terms_does_not_grow_with_the_corpus(spark):
    share = []
    for folder in (SF01, "/root/testdata/sf0.1"):
        found = pii.find(queries.table(spark, folder, "documents")).where("size(base) > 0")
        share.append(found.agg(F.avg((F.size("terms") > 0).cast("double"))).first()[0])
    assert share[1] <= share[0] + 0.01


def test_pii_query_against_the_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF01, "documents").select("doc_id", "text").collect()}
    rows = queries.op8_pii(spark, SF01).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def test_pii_edge_cases(spark):
    rows = pii.find(clashing(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and not any(r["base"] or r["terms"] for r in rows)
    assert pii.find(clashing(spark, EDGE).where("false")).count() == 0
    assert pd.Series([r["text"] for r in pii.sanitise(clashing(spark, EDGE)).collect()]).isna().sum() == 1


# --- licences ----------------------------------------------------------------

def test_license_forms(spark):
    mit = next(t for n, t in license_texts.KNOWN if n == "MIT")
    rows = [
        (1, mit), (2, "Copyright (c) 2021 Somebody\n\n" + mit.upper()), (3, re.sub(r"[,.()\"]", " ", mit).replace("sublicense", "sub-licence")),
        (4, mit + " And more."), (5, "code\n# Released under the MIT Licence\nmore"), (6, None), (7, ""), (None, mit), (8, mit), (8, mit),
    ]
    got = license_scan.scan(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["license"] for i in (1, 2, 3, 8, None)] == ["MIT"] * 5
    assert [by_id[i]["license"] for i in (4, 5, 6, 7)] == [None] * 4
    assert by_id[5]["line_licenses"] == "MIT" and by_id[4]["line_licenses"] is None
    assert by_id[6]["text_digest"] == hashlib.sha256(b"").hexdigest()
    assert license_scan.scan(clashing(spark, rows).where("false")).count() == 0


def test_known_digests_do_not_collide(spark):
    rows = license_scan.known_digests(spark).collect()
    assert all("," not in r["license"] for r in rows) and {r["license"] for r in rows} == {n for n, _ in license_texts.KNOWN + license_texts.DIGESTS}


def test_every_listed_text_is_found_whole(spark):
    rows = [(i, "Copyright The Some Authors\n\n" + text.replace("\n", "\r\n")) for i, (_, text) in enumerate(license_texts.KNOWN)]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(clashing(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in license_texts.KNOWN]


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this machine")
def test_long_licences_are_found_whole(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only",
             "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for i, file in enumerate(names):
        text = Path("/usr/share/common-licenses", file).read_text()
        rows += [(i, text), (i + 100, "(c) 2024 Somebody\n" + " ".join(text.split(" ")).upper()), (i + 200, text.replace("not", "", 1))]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(clashing(spark, rows)).collect()}
    assert [got[i] for i in range(len(names))] == [got[i + 100] for i in range(len(names))] == list(names.values())
    assert all(got[i + 200] is None for i in range(len(names)))


def test_license_query_uses_no_python(spark):
    plan = queries.op3_license_scan(spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
