"""Block-max search, double-array prefix tries and recompression against brute force and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from conftest import SF
from visitframe.llm import maxscore, prefix_trie, recompression
from visitframe.llm import queries as Q
from visitframe.llm.blocks import ALNUM, NOT_SPACE
from visitframe.llm.terms import gather, pieces

TABLES = "documents benchmark conversations".split()


@pytest.mark.parametrize("name", ["op11_block_max_search", "op12_double_array_trie", "op13_recompression"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(Q.ORACLES[name])
    assert sorted(rel.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM rel").fetchall(), key=key)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_pieces_keep_words_whole(most):
    rng = random.Random(2)
    texts = [None, "", "x" * 200, " " * 100 + "ab", *["".join(rng.choice("ab é \n") for _ in range(rng.randrange(300))) for _ in range(20)]]
    got = [[] for _ in texts]
    for p in pieces(pa.array(texts), NOT_SPACE, lower=False, max_bytes=most):
        w = p.words
        for r in range(p.rows):
            assert p.before == len(got[p.first + r])
            got[p.first + r] += [p.data[w.start[i]: w.end[i]].tobytes().decode() for i in range(w.row_start[r], w.row_start[r + 1])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_gather_joins_spans():
    data = np.frombuffer(b"abcdefgh", np.uint8)
    out, begin = gather(data, np.array([1, 4, 7]), np.array([2, 0, 1]), gap=1)
    assert out.tobytes() == b"bc  h " and begin.tolist() == [0, 3, 4, 6]
    assert len(gather(data, np.zeros(0, int), np.zeros(0, int))[0]) == 0


# --- ranked search ---------------------------------------------------------

def test_packed_numbers_come_back():
    v = np.array([0, 1, 127, 128, 300, 2**14, 2**21, 2**28, 2**31 - 1])
    data, ends = maxscore.pack(v)
    assert maxscore.unpack(data).tolist() == v.tolist() and ends[-1] == len(data)


def terms(t):
    return re.findall(maxscore.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_search(docs, items, k):
    cut = [(d, Counter(terms(t))) for d, t in docs]
    cut = [(d, c) for d, c in cut if c]
    n, total = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in cut:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_search_equals_plain_scores(spark, shard_bytes, monkeypatch):
    monkeypatch.setattr(maxscore, "BLOCK", 4)
    rng = random.Random(shard_bytes)
    words = [f"t{int(rng.paretovariate(0.7)) % 90}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(None, "t1 T1 t2"), (7, "t1 t2"), (200, None), (201, ""), (202, " -- "), (203, "t1 t2"), (204, "t1 t2"), (205, "t1, t1; t2_T2")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(12)] + [(50, "t1 t1 t2"), (50, "t1 t1 t2"), (None, "T3 t4"), (51, None), (52, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS score", "2 AS shard")
    found = maxscore.LexicalIndex(df, shard_bytes=shard_bytes).search(spark.createDataFrame(items, "item_id long, text string"), k=5).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_search(docs, items, 5)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert maxscore.LexicalIndex(docs).search(items).count() == 0
    assert maxscore.LexicalIndex(items.toDF("doc_id", "text")).search(items.limit(0)).count() == 0


def test_weak_lists_stay_packed():
    """Once the heap is full of good scores, most blocks of a frequent term are never unpacked."""
    rng = np.random.default_rng(0)
    shard = maxscore.Shard()
    rare = set(rng.choice(5000, 40, replace=False).tolist())
    for p in pieces(pa.array(["common" + " rare" * (1 + i % 3) * (i in rare) for i in range(5000)]), ALNUM, lower=True):
        shard.add(p, list(range(p.first, p.first + p.rows)))
    rows = {r["term"]: r for r in shard.rows(0, 5000, 5080).to_pylist()}
    m = np.frombuffer(rows[None]["best"], np.int64)
    lists = [maxscore.PostingList(w, *(rows[t][c] for c in ("last", "best", "ends", "payload")), m) for t, w in (("common", 1), ("rare", 4000))]
    heaps, ids = maxscore.Heaps(20), np.arange(5000)
    doc, score = maxscore.best_documents(lists, [1, 1], 5000, 20, 1)
    heaps.add(0, score, ids[doc], np.zeros(len(doc), np.uint8))
    for p in lists:
        p.full, p.unpacked = None, 0
    again, _ = maxscore.best_documents(lists, [1, 1], 5000, 20, heaps.threshold(0))
    assert set(heaps.rows[0][1].tolist()) <= set(again.tolist())
    assert 0 < lists[0].unpacked <= 40 < len(lists[0].last) + 2


# --- prefix tries ----------------------------------------------------------

def plain_nodes(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{role or ''}\0{text or ''}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest, len(text or "")))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members = {}
    for c, seq in new.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * p[-1][1] if p else 0
            leaves[p[:d]] += kids[p] == 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(new[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def talk(rng, n):
    rows = []
    for c in [rng.choice([*range(0, 400), -5, 1000]) for _ in range(n)]:
        have = sum(r[0] == c for r in rows)
        for t in range(have, have + rng.choice([0, 1, 2, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é", "", None, "ccc"])))
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 1 << 15])
def test_nodes_equal_plain_tries(spark, shard_turns):
    rows = talk(random.Random(shard_turns), 300)
    rows += [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(4)] + [(None, 1, "user", "x"), (900, None, "user", "z"), (900, 1, "user", "a"), (900, 1, "user", "b"), (900, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS path")
    got = prefix_trie.conversation_nodes(df, shard_turns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(plain_nodes(rows), key=str)


def test_nodes_of_an_empty_table(spark):
    assert prefix_trie.conversation_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_turnless_conversation_ends_at_the_root(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 1)
    got = prefix_trie.conversation_nodes(spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_double_array_finds_every_sequence():
    rng = random.Random(4)
    seqs = sorted({tuple(rng.randrange(1, 30) for _ in range(rng.randrange(0, 8))) for _ in range(300)})
    parent, label, depth, nodes = [-1], [0], [0], {(): 0}
    for s in seqs:
        for d in range(1, len(s) + 1):
            if s[:d] not in nodes:
                nodes[s[:d]] = len(parent)
                parent.append(nodes[s[:d - 1]]), label.append(s[d - 1]), depth.append(d)
    trie, slot = prefix_trie.pack_trie(parent, label, depth)
    assert len(set(slot.tolist())) == len(slot)
    for s in seqs:
        assert trie.walk(np.array(s, int)) == [slot[nodes[s[:d]]] for d in range(len(s) + 1)]
        assert len(trie.walk(np.array([*s, 31]))) == len(s) + 1
    assert sorted(np.concatenate(trie.levels()).tolist()) == sorted(slot.tolist())


def test_digests_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK_IDS", 7)
    seqs = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 'a' ELSE concat('b', id % 3) END AS key", "id AS conv_id")
    want = {}
    for i in range(1000):
        want.setdefault("a" if i < 900 else f"b{i % 3}", []).append(i)
    got = {r["key"]: r["ends_sha256"] for r in prefix_trie.ends_digests(seqs).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


# --- repeated passages -----------------------------------------------------

def passages(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.choice([10, 34, 35, 36, 60, 200]))] for _ in range(25)]
    texts = [None, "", "  ", "\n".join(["a"] * 100), " ".join(["a", "b"] * 80), " ".join(["a"] * 34), " ".join(["a", "b", "c"] * 70), " ".join(["c", "a", "b"] * 20), "A " * 35, "a " * 35]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.choice([0, 0, 1, 3])):
            t = list(b)
            for _ in range(rng.choice([0, 1, 2, 5])):
                i = rng.randrange(len(t))
                t[i:i + 1] = [rng.choice(words)] if rng.random() < 0.5 else rng.choice(base)[: rng.randrange(1, 60)]
            texts.append(" \t".join(t))
    return texts


@pytest.mark.parametrize("rounds,hot", [(0, 10_000), (1, 0), (3, 3), (4, 10_000)])
def test_cut_equals_brute_force(spark, rounds, hot, monkeypatch):
    monkeypatch.setattr(recompression, "HOT_ROWS", hot)
    texts = passages(rounds)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS x", "2 AS s")
    got = {r["doc_id"]: tuple(r)[1:] for r in recompression.RepeatedPassages(docs, rounds=rounds).cut().collect()}
    assert got == dict(enumerate(recompression.brute(texts)))


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, long), (1, "short"), (None, "x " + long), (None, None), (2, "only " * 3)]
    got = recompression.RepeatedPassages(spark.createDataFrame(rows, "doc_id long, text string")).cut(keep_text=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in got) == [
        (0, 0, 0, ""), (0, 41, 40, "x"), (1, 1, 0, "short"), (1, 40, 40, ""), (1, 40, 40, ""), (2, 3, 0, "only only only")]
    assert recompression.RepeatedPassages(spark.createDataFrame([], "doc_id long, text string")).cut().count() == 0


@pytest.mark.parametrize("most", [300, 1 << 20])
def test_pieces_of_a_long_text_hold_every_window_once(most):
    rng = random.Random(9)
    for _ in range(30):
        words = [f"w{rng.randrange(rng.choice([2, 3, 50, 3000]))}" for _ in range(rng.randrange(1, 400))]
        texts, seen = [" ".join(words), " ".join(words) + " x"], set()
        for row, g in recompression.document_groups(pa.array(texts), 20, 3, max_bytes=most):
            seen |= {(r, x) for r, a, n in zip(row.tolist(), g.start.tolist(), g.n.tolist()) for x in range(a, a + n)}
        assert seen == {(r, x) for r in (0, 1) for x in range(max(0, len(words) - 19 + r))}


def test_equal_passages_get_equal_groups():
    """Deep inside a shared passage both texts give the same names; only its ends differ."""
    rng = random.Random(1)
    shared = [f"s{rng.randrange(500)}" for _ in range(400)]
    names = []
    for side in ("a", "b"):
        text = " ".join([f"{side}{rng.randrange(500)}" for _ in range(90)] + shared + [f"{side}{rng.randrange(500)}" for _ in range(70)])
        (_, g), = recompression.document_groups(pa.array([text]), 35, 3)
        names.append(set(zip(g.x.tolist(), g.u.tolist())))
    both = names[0] & names[1]
    assert 0.85 * 366 / 14 < len(both) < 366 / 5
