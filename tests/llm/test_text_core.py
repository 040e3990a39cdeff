"""Words, shingles, near duplicates, FM-index and piece codec against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from visitframe.llm import components, setsketch
from visitframe.llm import queries as Q
from visitframe.llm.blocks import ALNUM, NOT_SPACE, hash_words, shingle_sets
from visitframe.llm.components import connected_components, star_forest
from visitframe.llm.fm_index import FMIndex, Phrases, find_contamination, search_texts, suffix_array, verdict
from visitframe.llm.piece_codec import ChunkTable, encode_decode
from visitframe.llm.setsketch import DEFAULT, NearDuplicates
from visitframe.session import stage

SPACED, ALNUMS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k):
    w = re.findall(SPACED, low(t))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(rows, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)), key=lambda r: rows[r][0])
                root[y] = x
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


@pytest.mark.parametrize("table,pattern", [(NOT_SPACE, SPACED), (ALNUM, ALNUMS)])
def test_words_and_shingles_equal_the_patterns(table, pattern):
    rng = random.Random(1)
    for _ in range(60):
        texts = ["".join(rng.choice(" \t\nabAB.,é漢-0\x0b\x1c ") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 20))]
        w, words = hash_words(texts, table), [re.findall(pattern, low(t)) for t in texts]
        assert w.count.tolist() == [len(x) for x in words]
        for k in (1, 3, 5):
            _, bounds = shingle_sets(w, k)
            assert np.diff(bounds).tolist() == [len({tuple(x[i:i + k]) for i in range(max(1, len(x) - k + 1))}) if x else 0 for x in words]


def test_likelihood_estimates_similarity_and_sketches_merge():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[400:2400])  # 1600 of 2400 shared
    ra, rb, rab = (DEFAULT.registers(x, np.array([0, len(x)])) for x in (a, b, np.sort(pool[:2400])))
    assert abs(DEFAULT.likelihood(ra, rb, np.array([2000]), np.array([2000]))[0] - 2 / 3) < 0.13
    assert (DEFAULT.merge(ra, rb) == rab).all()


def variants(rng, n):
    words = [f"w{i}" for i in range(200)]
    rows, d = [], 0
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 40, 80]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((d, " ".join(t)))
            d += 1
    rng.shuffle(rows)
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = variants(random.Random(7), 40) + [(9000, ""), (9001, None), (9002, " \n"), (9003, "Ab"), (9004, "aB")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in NearDuplicates(df, 3, 85, 100).classes().collect()}
    assert got == brute_classes(rows, 3, 85, 100)


def test_near_duplicates_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in Q.table(spark, SF, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in Q.QUERIES["op2_setsketch_dedup"](spark, SF).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in brute_classes(rows, 3, 85, 100).items()}


def test_near_duplicates_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert NearDuplicates(empty).classes().count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (1, "other text here now"), (5, "x " * 50_000)]
    out = NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string")).classes().collect()
    assert len(out) == 5 and {r["component_id"] for r in out} == {1, None, 5} and all(r["kept"] for r in out)


def test_components_of_chains_and_stars(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z0", f"z{i}") for i in range(1, 30)]
    random.Random(2).shuffle(edges)
    out = connected_components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert len(out) == 61 + 30 and {r["comp"] for r in out} == {"n000", "z0"} and len({r["sid"] for r in out}) == len(out)


def test_settled_stars_are_not_contracted_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "stage", lambda df, name: written.append(name) or stage(df, name))
    stars = spark.createDataFrame([("a", f"b{i}") for i in range(20)] + [("c", "d")], "a string, b string")
    assert star_forest(stars).count() == 21 and written == ["edges"]
    # stars of an earlier call with one new link: no round beyond those that change something
    written.clear()
    got = star_forest(stars.union(spark.createDataFrame([("b3", "d")], "a string, b string"))).collect()
    assert {(r["a"], r["b"]) for r in got} == {("a", x) for x in ["c", "d"] + [f"b{i}" for i in range(20)]} and len(got) == 22
    assert written.count("stars") <= 2


@pytest.mark.parametrize("most", [0, 10**6])
def test_near_duplicates_same_with_joins_and_with_broadcasts(spark, monkeypatch, most):
    for module, name in ((components, "SMALL_EDGES"), (setsketch, "SMALL_ROWS"), (setsketch, "REG_ROWS"), (setsketch, "SET_BYTES"), (setsketch, "ID_ROWS")):
        monkeypatch.setattr(module, name, most)
    rows = variants(random.Random(11), 40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).classes().collect()}
    assert got == brute_classes(rows, 3, 85, 100)


def test_common_pairs_are_formed_once(spark):
    full = [(k, bytes([s]), 100, bytes([c]), 100) for k in (3, 5, 9) for s, c in ((1, 1), (2, 2), (3, 2))] + [(7, bytes([4]), 100, bytes([4]), 100), (9, bytes([4]), 100, bytes([4]), 100)]
    df = spark.createDataFrame(full, "key long, sid binary, n long, comp binary, common long")
    got = [(bytes(r["a"])[0], bytes(r["b"])[0]) for r in NearDuplicates(spark.createDataFrame([], "doc_id long, text string"))._common_pairs(df).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)]


def brute_hits(text, items, window):
    words = re.findall(ALNUMS, low(text))
    hit, names = [0] * len(words), set()
    for name, t in items:
        w = re.findall(ALNUMS, low(t))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            phrase = w[s:s + window]
            for i in range(len(words) - len(phrase) + 1):
                if words[i:i + len(phrase)] == phrase:
                    names.add(name)
                    hit[i:i + len(phrase)] = [1] * len(phrase)
    return len(words), sum(hit), sorted(names)


def test_fm_index_equals_brute_force():
    rng, voc = random.Random(3), ["a", "b", "B", "c", "é", "x9"]

    def text(n):
        return " ".join(rng.choice(voc[: rng.choice([2, 3, 6])]) for _ in range(n))

    for _ in range(80):
        items = [(str(i), text(rng.randrange(0, 9))) for i in range(rng.randrange(0, 6))]
        texts = [text(rng.randrange(0, 40)) if rng.random() < 0.9 else None for _ in range(rng.randrange(1, 12))]
        got = [(int(a), sum(y - x for x, y in b), c) for n, s, i in search_texts(pa.array(texts, pa.string()), Phrases(items, 4), rng.choice([1, 30, 10_000])) for a, b, c in zip(n, s, i)]
        assert got == [brute_hits(t, items, 4) for t in texts]


def test_suffix_array_and_location():
    seq = np.array([2, 1, 2, 2, 1, 2, 2, 2, 1, 1, 1, 3])
    assert suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
    index = FMIndex(seq, 4)
    lo, hi = index.search(np.array([[2, 2], [0, 3], [3, 3]]), np.array([2, 1, 2]))
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == [2, 5, 6] and (hi - lo).tolist() == [3, 1, 0]


def test_contamination_query_and_blocks(spark):
    docs = [(r["doc_id"], r["text"]) for r in Q.table(spark, SF, "documents").collect()]
    bench = [(str(r["item_id"]), r["text"]) for r in Q.table(spark, SF, "benchmark").collect()]
    want = {}
    for d, t in docs:
        n, h, i = brute_hits(t, bench, 13)
        want[d] = (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0 and 20 * h >= n)
    rows = Q.QUERIES["op8_fm_index_decontamination"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == want
    assert any(w[4] for w in want.values())
    blocks = verdict(find_contamination(Q.table(spark, SF, "documents"), Q.table(spark, SF, "benchmark"), max_chars=700)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in blocks} == {d: w[:2] for d, w in want.items()}


def test_contamination_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (2, "", "q"), (None, "one two", "q"), (3, "one, TWO three", "q")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([("i", "two"), ("i", "one two"), ("n", None), (None, "three"), ("e", "--")], "item_id string, text string")
    out = {(r["doc_id"], r["text"]): (r["n_words"], r["n_hit"], r["items"]) for r in verdict(find_contamination(docs, bench)).collect()}
    assert out[(None, "one two")] == (2, 2, ["i"]) and out[(3, "one, TWO three")] == (3, 3, ["i"]) and out[(1, None)] == (0, 0, [])
    assert find_contamination(docs, bench.limit(0)).count() == 5 and find_contamination(docs.limit(0), bench).count() == 0


def test_chunk_table_equals_the_library():
    table, rng = ChunkTable(Q.tokenizer("piece_bpe_32k.model"), max_chunks=500), random.Random(1)
    letters = " ▁ ab\n\t</s>é漢字\U0001F600 xX▁theing  0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))) for _ in range(4000)] + ["", " ", "▁", "  ", "a ", "é" * 3000]
    for t, (ids, back) in zip(texts, table.encode(texts)):
        want = table.model.encode(t)
        assert ids == ",".join(map(str, want)) and back == table.model.decode(want)


def test_piece_query(spark):
    table = ChunkTable(Q.tokenizer("piece_bpe_32k.model"))
    docs = {r["doc_id"]: r["text"] for r in Q.table(spark, SF, "documents").collect()}
    for r in Q.QUERIES["op9_piece_codec"](spark, SF).collect():
        ids = table.model.encode(docs[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(table.model.decode(ids).encode()).hexdigest())
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a b")], "doc_id long, text string")
    rows = encode_decode(odd, Q.tokenizer("piece_bpe_32k.model"), keep_ids=True, keep_text=True).collect()
    assert [len(r["ids"]) for r in rows] == [r["n_tokens"] for r in rows] and sorted(r["decoded"] for r in rows) == ["", "", "a b"]
