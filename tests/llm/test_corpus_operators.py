"""Mixing, token files, SimHash, suffix deduplication, decontamination, nearest
neighbours and the pipeline, each against a brute-force version."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from ledgerlake.llm import ann, decontam, mixing, queries, simhash, suffix_dedup, token_files
from ledgerlake.llm.collection_bwt import shared_starts
from ledgerlake.llm.components import connected_components

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (4, "word"), (None, "word"), (5, "ab " * 100_000)]
EXTRA = "doc_id long, text string, source string, row_key string, fp int, n int, position string"


def clashing(spark, rows, source=lambda i: "s"):
    """Rows (doc_id, text) in a frame with extra columns that operators use inside."""
    return spark.createDataFrame([(i, t, source(i), "x", 1, 2, "p") for i, t in rows], EXTRA).repartition(3)


def texts_of(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()}


# --- mixing ------------------------------------------------------------------

def water_level(sizes, weights, budget, passes):
    """Targets by raising a common level until the budget is met."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        if sum(min(passes * s, mid * w) for s, w in zip(sizes, weights)) < budget:
            low = mid
        else:
            high = mid
    return [min(passes * s, high * w) for s, w in zip(sizes, weights)]


def test_targets_are_the_water_level(spark):
    rng = random.Random(4)
    for _ in range(4):
        names = [f"s{i}" for i in range(rng.randint(1, 9))] + [None]
        sizes = [rng.choice([0, 1, 10, 500, 9000]) for _ in names]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        weights = [(5, 2, 1)[i % 3] for i in range(len(names))]
        for name, want in zip(names, water_level(sizes, weights, 1.5 * sum(sizes), 2)):
            assert math.isclose(got[name], want, rel_tol=1e-9, abs_tol=1e-6)


def test_mix_takes_the_targets_and_positions_follow_the_schedule(spark):
    docs = queries.table(spark, SF01, "documents")
    mixed = mixing.mix(docs).cache()
    assert mixed.count() == docs.count()
    per = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("all"))
    for r in per.collect():
        assert abs(r["taken"] - r["target"]) <= 0.5 and r["size"] == r["all"]
    assert mixed.where("taken > 2 * size or taken < 0").count() == 0
    assert mixed.selectExpr("explode(positions) as p").where("p < 0 or p > 1").count() == 0
    again = mixing.mix(docs.repartition(5))
    assert again.exceptAll(mixed).count() == 0
    whole = mixing.mix(docs, whole=True).where("size > 0")
    assert whole.where("taken % size <> 0").count() == 0
    # a rising source has met less of its demand in the first half than a falling one
    early = {r["k"]: r["p"] for r in mixed.join(docs.select("source").distinct().orderBy("source").selectExpr("source", "row_number() over (order by source) - 1 as place"), "source")
             .selectExpr("place % 3 as k", "explode(positions) as p").groupBy("k").agg(F.avg((F.col("p") < 0.5).cast("double")).alias("p")).collect()}
    assert early[1] < early[0] < early[2]


def test_position_inverts_the_integral(spark):
    for place, points in enumerate(mixing.SCHEDULES):
        row = spark.range(11).select((F.col("id") / 10).alias("share")).withColumn("t", mixing._position(F.col("share"), F.lit(place))).collect()
        for r in row:
            steps = np.linspace(0, r["t"], 20001)
            mean = lambda x: np.interp(x, *zip(*points))
            total = np.trapezoid(mean(np.linspace(0, 1, 20001)), np.linspace(0, 1, 20001))
            assert abs(np.trapezoid(mean(steps), steps) / total - r["share"]) < 1e-4


def test_mix_edge_cases(spark):
    docs = clashing(spark, EDGE, lambda i: None if i in (1, None) else "a" if i == 5 else "b")
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(EDGE) and {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert abs(sum(r["taken"] for r in rows) - 1.5 * sum(r["size"] for r in rows)) < 2  # a source rounds its target
    assert mixing.mix(docs.where("false")).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("text is null").count() == 0


# --- token files -------------------------------------------------------------

def reference_rows(rows):
    from tokenizers import Tokenizer

    model, start, out = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_encoder_equals_the_whole_model():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "b", "é", "ß", ".", ",", "'", "'s", "1", "٣", "²", "中", "😀", " ", "\x1c", "\x85", "\x0b", "ABC", "<|endoftext|>", "!", "_", "́", "ǀ", "ª", "\r\n", "don't", "%%%"]
    lines = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(6000)] + ["", " ", "a ", " a"]
    encoder = token_files.Encoder(queries.tokenizer_path(), keep=2000)
    got = [ids.tolist() for i in range(0, len(lines), 500) for ids in encoder.encode(lines[i : i + 500])]
    want = [e.ids + [0] for e in encoder.model.encode_batch(lines, add_special_tokens=False)]
    assert got == want


def test_pieces_are_merged_once_however_many_units_hold_them():
    ends = ["".join(p) for n in (1, 2, 3) for p in itertools.product(".,!?;", repeat=n)]
    words = ["".join(p) for p in itertools.product("abcd", repeat=2)]
    lines = [f"x {w}{e}" for e in ends for w in words]
    encoder, merged = token_files.Encoder(queries.tokenizer_path(), keep=600), []
    model = encoder.model

    def merge(piece):
        merged.append(piece)
        return model.model.tokenize(piece)

    encoder.model = SimpleNamespace(model=SimpleNamespace(tokenize=merge), encode_batch_fast=model.encode_batch_fast)
    got = [ids.tolist() for i in range(0, len(lines), 50) for ids in encoder.encode(lines[i : i + 50])]
    assert got == [e.ids + [0] for e in model.encode_batch(lines, add_special_tokens=False)]
    # x stands without and with a space
    assert len(merged) == len(set(merged)) == 2 + len(words) + len(ends) and len(encoder.units.known) < 600


def test_words_with_marks_are_cut_into_units_that_repeat():
    ends = ["".join(p) for n in (1, 2, 3) for p in itertools.product(".,!?;", repeat=n)] + [".\n", "\n", "1"]
    words = ["".join(p) for p in itertools.product("abcdé", repeat=2)]
    lines = [f"x {w}{e}" for e in ends for w in words] + ["x don't.\n×", "x aa\n\nbb"]
    encoder = token_files.Encoder(queries.tokenizer_path())
    got = [ids.tolist() for ids in encoder.encode(lines)]
    assert got == [e.ids + [0] for e in encoder.model.encode_batch(lines, add_special_tokens=False)]
    # 25 words and 158 ends, not all their pairs; what is not plain stays whole
    assert set(encoder.units.known) - {None, "x", " x"} == {" " + w for w in words} | set(ends) - {".\n"} | {" don't.\n×", "bb"}


def test_texts_are_cut_like_the_models_own_pattern(monkeypatch):
    rng = random.Random(11)
    plain = [" a", "b", "Z", "é", "ß", "ɏ", "ÿ", "\n", "1", "9", ".", "~", "&", "("]
    lines = ["".join(rng.choices(plain + ["×", "÷", "ɐ", "'s", "\t", "中"] * (i % 2), k=rng.randint(0, 12))) for i in range(4000)] + ["", None, " ", "\n\n", "a "]
    encoder = token_files.Encoder(queries.tokenizer_path(), keep=500)
    want = [e.ids + [0] for e in encoder.model.encode_batch([t or "" for t in lines], add_special_tokens=False)]
    for size in (1, 100, 8 << 20):
        monkeypatch.setattr(token_files, "PORTION_BYTES", size)
        assert [ids.tolist() for ids in encoder.encode(lines)] == want


def test_table_of_units_is_bounded_by_their_ids():
    encoder = token_files.Encoder(queries.tokenizer_path(), keep=100)
    for i in range(20):
        encoder.encode([f"{chr(0x4E00 + i)}" * 200])
    assert encoder.units.used <= 800 + 600


def test_table_of_units_keeps_those_met_again():
    encoder, learnt = token_files.Encoder(queries.tokenizer_path(), keep=300), []
    learn = encoder._learn
    encoder._learn = lambda units: (learnt.extend(units), learn(units))
    model = encoder.model
    for i in range(30):
        lines = [f"the same words {i * 40 + j:x}z" for j in range(40)]
        assert [ids.tolist() for ids in encoder.encode(lines)] == [e.ids + [0] for e in model.encode_batch(lines, add_special_tokens=False)]
        assert len(encoder.units.known) <= 300 + 100
    assert learnt.count(" same") == learnt.count(" words") == learnt.count("the") == 1


def test_table_of_units_starts_anew_if_most_are_met_again():
    encoder = token_files.Encoder(queries.tokenizer_path(), keep=100)
    for i in range(20):
        lines = [" ".join(f"{chr(97 + (i + k) % 20)}{j}" for j in range(60)) for k in range(2)]
        for _ in range(2):
            assert [ids.tolist() for ids in encoder.encode(lines)] == [e.ids + [0] for e in encoder.model.encode_batch(lines, add_special_tokens=False)]
    assert len(encoder.units.known) <= 100 + 200


def test_table_of_units_takes_a_bounded_part_of_a_workers_memory():
    encoder, most = token_files.Encoder(queries.tokenizer_path()), 0
    letters = [chr(97 + i) for i in range(26)]
    words = ["".join(p) for p in itertools.product(letters, repeat=4)][:400_000]
    for i in range(0, len(words), 50_000):
        encoder.encode([" ".join(words[i : i + 50_000])])
        most = max(most, len(encoder.units.known))
    # two workers of an executor hold one each, beside what the JVM takes
    assert most <= 300_000 and token_files.PORTION_BYTES <= 2 << 20


def test_token_query_round_trip(spark):
    rows = list(texts_of(spark, SF001).items())
    got = [tuple(r) for r in queries.op6_token_files(spark, SF001).orderBy("doc_id").collect()]
    assert got == reference_rows(rows)


def test_token_edge_cases_and_requested_documents(spark, tmp_path):
    docs = clashing(spark, EDGE)
    manifest = token_files.write(docs, queries.tokenizer_path(), str(tmp_path / "out"), frame_bytes=64)
    got = sorted((tuple(r) for r in token_files.read(manifest).collect()), key=lambda r: r[1])
    assert got == reference_rows(EDGE)
    some = {r["doc_id"]: r["ids"] for r in token_files.read_documents(manifest, [2, 5, 99]).collect()}
    assert set(some) == {2, 5} and some[2] == [0] and len(some[5]) == got[-1][2]
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_draft")]
    assert token_files.read(token_files.write(docs.where("false"), queries.tokenizer_path())).count() == 0


def test_file_is_plain_zstandard_and_damage_is_found(tmp_path):
    path = tmp_path / "f.zst"
    with path.open("wb") as out:
        writer = token_files.FileWriter(out, frame_bytes=40)
        for i in range(30):
            writer.add(i, np.arange(i, dtype="<u4"))
        writer.close()
    import pyarrow.fs as fs

    def reader():
        return token_files.FileReader(fs.LocalFileSystem().open_input_file(str(path)))

    assert [len(d.ids) for d in reader().documents()] == list(range(30))
    with path.open("rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain == b"".join(np.arange(i, dtype="<u4").tobytes() for i in range(30))
    one = reader()
    seen = []
    one.frame = lambda i, f=one.frame: seen.append(i) or f(i)
    assert [d.ids.tolist() for d in one.documents({7})] == [list(range(7))] and len(seen) == 1
    data = bytearray(path.read_bytes())
    data[int(reader().offsets[3]) + 12] ^= 0xFF
    path.write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(reader().documents())


# --- SimHash -----------------------------------------------------------------

def plain_fingerprint(text, size=3):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=3):
    """prints: list of (id, fingerprint); smallest id reachable by row."""
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in prints]


def test_fingerprints_of_texts_with_many_shingles():
    rng = random.Random(1)
    lines = [" ".join(rng.choices("abcdefgh", k=n)) for n in (0, 1, 2, 3, 254, 255, 256, 257, 258, 900)]
    hashes = [simhash.shingle_hashes(t, 3) for t in lines]
    got = simhash.majority_bits(np.array([h for x in hashes for h in x], np.uint64), np.array([len(h) for h in hashes]))
    assert [int(g) for g in got] == [plain_fingerprint(t) for t in lines]


@pytest.mark.parametrize("hot", [4096, 4])
def test_links_connect_what_brute_force_connects(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SEGMENT", hot)
    rng = random.Random(hot)
    prints = [0, (1 << 64) - 1]
    for _ in range(12):  # clusters around centres, and chains from them
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            centre2 = centre
            for _ in range(rng.randint(0, 4)):
                centre2 ^= 1 << rng.randrange(64)
            prints.append(centre2)
            if rng.random() < 0.3:
                centre = centre2
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in edges)
    number = {p: i for i, p in enumerate(prints)}
    want = {i: c for i, _, c in plain_components([(number[p], p) for p in prints])}
    found = connected_components(spark.createDataFrame([(number[a], number[b]) for a, b in edges], "a long, b long"))
    got = {r["node"]: r["root"] for r in found.collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert len(edges) < 64 * len(prints)  # a forest for each key, never all pairs


def test_simhash_query_against_brute_force(spark):
    rows = texts_of(spark, SF01)
    want = {(i, f"{f:016x}", c) for i, f, c in plain_components([(i, plain_fingerprint(t)) for i, t in rows.items()])}
    assert {tuple(r) for r in queries.op10_simhash(spark, SF01).collect()} == want


def test_simhash_edge_cases(spark):
    docs = clashing(spark, EDGE + [(9, "WORD")])
    got = simhash.components(docs).collect()
    assert len(got) == len(EDGE) + 1
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 9: 4, None: 4}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]
    nameless = clashing(spark, [(None, "x"), (None, "x"), (None, "y z")])
    assert sorted(r["text"] for r in simhash.drop_near_duplicates(nameless).collect()) == ["x", "y z"]
    assert simhash.components(docs.where("false")).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert {got[i] for i in range(100, 401)} == {100} and {got[i] for i in range(1000, 1300)} == {1000}


# --- suffix deduplication ----------------------------------------------------

def plain_removal(rows, span=200):
    """rows: (doc_id, bytes); multiset of results."""
    seen = Counter(d[p : p + span] for _, d in rows for p in range(len(d) - span + 1))
    out = Counter()
    for i, d in rows:
        gone = bytearray(len(d))
        for p in range(len(d) - span + 1):
            if seen[d[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for j in range(len(d)) if gone[j] and not (j and gone[j - 1]))
        out[i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_column_wise_construction_against_brute_force():
    rng = random.Random(2)
    for trial in range(150):
        weights = np.ones(300, int)
        weights[256] = 3 if trial % 2 else 1
        strings = [np.array([256 if trial % 2 and rng.random() < 0.1 else rng.choice([97, 98, 99]) for _ in range(rng.randint(1, 14))], np.uint16) for _ in range(rng.randint(2, 8))]
        length = rng.randint(2, 6)
        flat = [[(int(x), k, at) for at, x in enumerate(s) for k in range(weights[x])] for s in strings]
        seen = Counter(tuple(c[:2] for c in f[p : p + length]) for f in flat for p in range(len(f) - length + 1) if f[p][1] == 0)
        for f, shared in zip(flat, shared_starts(strings, weights, length)):
            for p in range(len(f)):
                if f[p][1] == 0:
                    assert shared[f[p][2]] == (p + length <= len(f) and seen[tuple(c[:2] for c in f[p : p + length])] > 1)


@pytest.mark.parametrize("hot", [4000, 3])
def test_removal_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CORE", hot)
    rng = random.Random(hot)
    noise = lambda n: "".join(rng.choices("abcdefghij é\n", k=n))
    passages = [noise(k) for k in (150, 199, 200, 201, 260, 500, 900)]
    rows = []
    for i in range(50):
        text = ""
        for _ in range(rng.randint(0, 4)):
            passage = rng.choice(passages)
            if rng.random() < 0.5:
                at = rng.randrange(len(passage))
                passage = passage[:at] + "x" + passage[at + 1 :]
            text += noise(rng.randint(0, 150)) + passage
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "a" * 1000), (103, "ab" * 300), (104, rows[3][1]), (5, rows[5][1]), (None, noise(300)), (105, noise(90) + "a" * 250)]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(clashing(spark, rows)).collect())
    assert got == plain_removal([(i, (t or "").encode()) for i, t in rows])


def test_pieces_of_a_long_text_do_not_depend_on_chunks(monkeypatch):
    data = random.Random(6).randbytes(5000)
    starts = lambda: np.concatenate([np.repeat(p[1] + p[2], p[3]) for p in suffix_dedup.pieces(data)])
    whole = starts()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    assert (starts() == whole).all() and len(whole) == len(data) - 199


def test_suffix_query_against_brute_force(spark):
    rows = texts_of(spark, SF001)
    got = Counter(tuple(r) for r in queries.op9_suffix_dedup(spark, SF001).collect())
    assert got == plain_removal([(i, t.encode()) for i, t in rows.items()])
    assert suffix_dedup.remove_repeats(clashing(spark, []).where("false")).count() == 0


def test_repeated_rows_cost_one_documents_marks(spark):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefgh ", k=900))
    own = "".join(rng.choices("abcdefgh ", k=700))
    rows = [(7, text)] * 3000 + [(None, text[:500])] * 2000 + [(8, own + text[100:450]), (9, own[:300])]
    frame = clashing(spark, rows)
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(frame).collect())
    # what two copies of each leave is what any number of copies leaves
    few = plain_removal([(7, text.encode())] * 2 + [(None, text[:500].encode())] * 2 + [(8, rows[-2][1].encode()), (9, own[:300].encode())])
    want = {r: n if r[0] in (8, 9) else {7: 3000, None: 2000}[r[0]] for r, n in few.items()}
    assert got == want
    marks = suffix_dedup.row_marks(suffix_dedup._documents(frame, "doc_id", "text"))
    assert marks.agg(F.max(F.size("marks"))).first()[0] < 100


# --- decontamination ---------------------------------------------------------

def plain_alignment(a, b):
    table, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
            best = max(best, table[i, j])
    return best


def test_alignment_against_the_full_table():
    rng, params = np.random.default_rng(1), decontam.Matching()
    for _ in range(200):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 15))
        score, start, end = decontam.align(a, b, params)
        assert score == plain_alignment(a, b) == plain_alignment(a, b[start:end])


def test_copies_and_edited_copies_are_found_and_others_left(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=4))
    common = [word() for _ in range(30)]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(rng.randint(15, 60)))) for i in range(20)]
    docs, want = [], set()
    for i in range(200):
        body = [rng.choice(common) if rng.random() < 0.6 else word() for _ in range(rng.randint(5, 300))]
        if i % 5 < 2:
            item, text = items[rng.randrange(20)]
            passage = [word() if i % 5 and rng.random() < 0.2 else w for w in text.split()]
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() + "," for w in passage]
            want.add((i, item))
        elif i % 5 == 2:  # a phrase of an item is no copy
            text = rng.choice(items)[1].split()
            body += text[3:9]
        docs.append((i, " ".join(body)))
    bench = spark.createDataFrame(items + [(77, None), (78, "two words"), (None, items[0][1])], "item_id long, text string")
    found = decontam.contaminated(clashing(spark, docs), bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found if r["item_id"] is not None}
    assert got == want, (got - want, want - got, [len(items[i][1].split()) for _, i in got ^ want])
    assert all(0.4 <= r["score"] <= 1 for r in found)
    assert {(r["doc_id"], 0) for r in found if r["item_id"] is None} == {p for p in want if p[1] == 0}
    small = decontam.contaminated(clashing(spark, docs), bench, decontam.Matching(block_words=100))
    assert {(r["doc_id"], r["item_id"]) for r in small.where("item_id is not null").collect()} == want
    kept = decontam.drop_contaminated(clashing(spark, docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(200)) - {i for i, _ in want} and kept.columns == EXTRA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_a_passage_in_most_documents_is_still_found(spark):
    rng = random.Random(9)
    passage = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(20))
    docs = [(i, f"x{i} y{i} {passage} z{i}" if i % 3 else f"x{i} y{i} z{i}") for i in range(90)]
    found = decontam.contaminated(clashing(spark, docs), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == {i for i in range(90) if i % 3}


def test_parts_and_dense_edits_of_an_item_are_found(spark):
    rng = random.Random(10)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    short, long, plain = words(59), words(3000), words(18)
    edited = [w if (i + 1) % 3 else "new" for i, w in enumerate(plain)]
    docs = {1: short[10:45], 2: long[500:2000], 3: edited, 4: short[3:11], 5: long[40:50], 6: words(30)}
    docs = [(i, " ".join(words(20) + d + words(20))) for i, d in docs.items()]
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long)), (3, " ".join(plain))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(clashing(spark, docs), bench).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 3)}
    assert (found[1, 1]["start"], found[1, 1]["end"]) == (20, 55) and found[2, 2]["score"] == 0.5
    kept = decontam.drop_contaminated(clashing(spark, docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6}
    # the best alignment is too short for the item, the next one is not
    item = np.arange(1, 25)
    text = np.concatenate([item[:11], np.zeros(30, int), np.where(np.arange(24) % 3 == 2, 0, item)])
    params = decontam.Matching(threshold=0.4, passage=50)
    assert decontam.align(item, text[:41], params)[0] == 22 and decontam.accepted(item, text, params)[1] >= 41


def test_words_of_many_texts_are_cut_once_a_part(monkeypatch):
    rng = random.Random(11)
    parts = [" ", "  ", "\n", "_", "-", "ΑΣ", "σ", "Σ", "ΟΔΟΣ'", "İ", "ß", "É", "é", "the", "The", "²", "٣", "中文", "ǅ", ".", "A"]
    lines = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)] + ["", None, " "]
    block = decontam.Block(3)
    for i in range(0, 40, 4):
        block.add(i, decontam.words(" ".join(lines[i : i + 4])))
    block.close()
    for size in (1, 500, 1 << 20):
        seen = []
        for first, portion in decontam.portions(pa.array(lines, pa.string()), size):
            assert first == len(seen)
            numbers, begins = block.numbers(portion)
            seen += [numbers[a:b].tolist() for a, b in zip(begins, begins[1:])]
        assert seen == [[block.vocabulary.get(w, 0) for w in decontam.words(t or "")] + [0, 0] for t in lines]
    calls = []

    class Pattern:
        def findall(self, text, pattern=decontam._WORD):
            calls.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(decontam, "_WORD", Pattern())
    text = "a phrase, of twelve words; that every document has, so it repeats often."
    assert list(decontam.matched(block, pa.array([text] * 1000), decontam.Matching())) == []
    assert len(calls) <= len(text.split(" "))
    # no run of words goes on into the next text
    item = "one two three four five six seven eight nine ten".split()
    block = decontam.Block(3)
    block.add(1, item)
    block.close()
    assert not len(block.hits(block.numbers(pa.array([" ".join(item[i : i + 2]) for i in range(0, 10, 2)]))[0])[0])


def test_decontamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, "word word word word")], "item_id long, text string")
    assert decontam.contaminated(clashing(spark, EDGE), bench).count() == 0
    assert decontam.contaminated(clashing(spark, EDGE), bench.where("false")).count() == 0
    assert decontam.drop_contaminated(clashing(spark, EDGE), bench.where("false")).count() == len(EDGE)
    assert decontam.contaminated(clashing(spark, EDGE).where("false"), bench).count() == 0


# --- nearest neighbours ------------------------------------------------------

def plain_nearest(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, q in rows:
        if i % 50 == 0:
            score = ann.cosine(np.broadcast_to(np.array(q, float), x.shape), x)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def ranked(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = ann.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(ann.hadamard(y), x)


@pytest.mark.parametrize("hashes", [1, 2])
def test_own_bucket_is_the_first_probed(hashes):
    x = ann._scale(np.random.default_rng(0).normal(size=(40, 20)))
    p = ann.Hashing(hashes=hashes, probes=4)
    for t in range(3):
        assert (ann.probed(x, t, p)[:, 0] == ann.buckets(x, t, p)).all()


def test_recall_and_exact_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, SF01, "embeddings").collect()]
    want, got = plain_nearest(rows), ranked(queries.op4_nearest(spark, SF01))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    scores = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(s == scores[q, i] for q, v in got.items() for i, s in v if (q, i) in scores)


def test_one_vector_many_times_in_split_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ([1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist())) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = ranked(ann.search(frame, F.col("vec_id") % 50 == 0, params=ann.Hashing(block=16)))
    want = plain_nearest(rows)
    same = [q for q in want if q % 3]
    assert same and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in same)


def test_repeated_ids_near_a_query_cost_no_neighbours(spark):
    rng = np.random.default_rng(3)
    near = lambda spread, centre=rng.normal(size=8): (centre + spread * rng.normal(size=8)).tolist()
    rows = [(50, near(0.0)), *((7, near(1e-5)) for _ in range(9)), *((8, near(2e-5)) for _ in range(4)), *((i, near(1e-3)) for i in range(10, 22))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    score = {}
    for i, v in rows:
        if i != 50:
            score[i] = max(score.get(i, -1.0), float(ann.cosine(np.array([rows[0][1]]), np.array([v]))[0]))
    want = sorted(score, key=lambda i: (-score[i], i))[:5]
    assert {7, 8} < set(want)
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert ann._best(ids[:1], vectors[:1], ids, vectors, 5)["vec_id"].tolist() == want
    for params in (ann.Hashing(tables=1, probes=1), ann.Hashing(), ann.Hashing(block=4)):
        got = ranked(ann.search(frame, F.col("vec_id") == 50, params=params))
        assert got[50] == [(i, score[i]) for i in want]


def test_vectors_without_part_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]),
            (50, [-1.0, 0.0]), (100, None), (None, [1.0, 0.0]), (7, [1.0]), (0, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
    got = ranked(ann.search(frame, F.col("vec_id") % 50 == 0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [6, 50], 50: [0, 6]} or {q: [i for i, _ in v] for q, v in got.items()} == {0: [6, 50], 50: [6, 0]}
    assert ann.search(frame.where("vec_id in (1, 2)"), F.lit(True)).count() == 0
    assert ann.search(frame.where("false"), F.lit(True)).count() == 0


# --- pipeline ----------------------------------------------------------------

def test_pipeline_stages_against_their_operators(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF001, "documents").cache()
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, step(spark, docs, SF001).cache()
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "simhash near-dedup":
            rows = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in before.collect()]
            assert kept == {c for _, _, c in plain_components(rows)} and docs.count() == len(kept)
        if name == "benchmark decontamination":
            hit = {r["doc_id"] for r in decontam.contaminated(before, queries.table(spark, SF001, "benchmark")).collect()}
            assert kept == {r["doc_id"] for r in before.collect()} - hit
        if name == "mixing":
            taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before, whole=True).where("size > 0").collect()}
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter({i: n for i, n in taken.items() if n})
        if name == "token output":
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert sorted((tuple(r) for r in docs.collect()), key=lambda r: r[1]) == reference_rows(rows)
        else:
            assert docs.columns == columns


def test_pipeline_takes_odd_rows(spark, tmp_path):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long, label int, __n int"
    rows = [(i, t, None, None, None, 1, 2) for i, t in EDGE] + [(20 + i, f"some words number {i} here {i * 7}", "en", f"s{i % 3}", 5, None, None) for i in range(9)]
    for name in ("labels", "benchmark"):
        queries.table(spark, SF001, name).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], columns).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_filtering_stages_carry_columns_of_any_name(spark):
    """Names that operators use inside, and names with dots, keep their values."""
    import corpus_pipeline

    names = ["__n", "__row_key", "__kept_id", "__kept_key", "row", "rest", "row_id", "kept_id", "fp", "a.b", "h", "size", "key", "in_text"]
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60)), "en", "s", 9, *[f"{n}-{i}" for n in names]) for i in range(40)]
    rows += [rows[3], (50, rows[5][1], *rows[5][2:])]
    fields = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{n}` string" for n in names]])
    docs = spark.createDataFrame(rows, fields).repartition(3)
    want = {r[0]: tuple(r) for r in rows[:40]}
    for stage_name, step in corpus_pipeline.STAGES[:4]:
        docs = step(spark, docs, SF001)
        got = [tuple(r) for r in docs.collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], stage_name
        assert {r[0] for r in got} <= set(want) | {50} and all(r == want.get(r[0], rows[-1]) for r in got), stage_name
    assert len({r[0] for r in got}) == 40
