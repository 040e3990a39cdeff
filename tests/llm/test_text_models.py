"""Host reputation, line spread, quality, personal data, templates, fingerprints, language model and pipeline."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from visitframe.llm import queries as Q, weak_pii
from visitframe.llm.chat_template import DEFAULT, Reader, TemplateError, compile_template, escaper, fold_block, format_digests, parse, render, unescape
from visitframe.llm.fm_index import find_contamination, verdict
from visitframe.llm.host_reputation import Rule, host_reputation, judge_urls
from visitframe.llm.line_spread import dedup_lines
from visitframe.llm.maxent_lm import score_documents
from visitframe.llm.prefix_hash import PrefixHashes, Windows, code_points, edited, fingerprint_documents, likeness
from visitframe.llm.pu_quality import keep_good, score_quality
from visitframe.llm.weak_pii import aggregate_votes, find_personal_data, luhn, strict_spans
from visitframe.session import stage

TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({Q.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))


# host reputation

def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark):
    pages, labels, p = [], [], 0
    for host, n, good in [("bad.spam.io", 200, 0), ("new.spam.io", 1, 0), ("fine.site.io", 200, 190), ("tiny.site.io", 1, 0), ("other.net", 50, 45)]:
        for i in range(n):
            pages.append((p, f"http://{host}/x/{p}"))
            labels.append((p, int(i < good)))
            p += 1
    pages += [(9001, "http://unseen.spam.io/"), (9002, None), (9003, "nothing"), (9004, "HTTP://A.Example.ORG/es/1?q#f"), (9004, "http://x.org/")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("rule", F.lit("clash"))
    lab = spark.createDataFrame(labels, "page_id long, outcome int")
    rules = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "fine.site.io/x/2")]
    out = judge_urls(df, lab, rules).collect()
    assert len(out) == len(pages)
    verdicts = collections.defaultdict(set)
    for r in out:
        verdicts[r["host"], r["rule"]].add(r["verdict"])
    assert verdicts["bad.spam.io", None] == {"block"} and verdicts["fine.site.io", None] == {"allow"} and verdicts["tiny.site.io", None] == {"allow"}
    assert verdicts["fine.site.io", "fine.site.io/x/2"] == {"block"} and verdicts["a.example.org", "example.org/es/"] == {"block"} and verdicts["x.org", "org/"] == {"allow"}
    rep = {r["host"]: r for r in host_reputation(df.join(lab, "page_id", "left").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), "outcome")).collect()}
    assert rep["new.spam.io"]["m_host"] < rep["tiny.site.io"]["m_host"] and rep["new.spam.io"]["high"] - rep["new.spam.io"]["low"] > rep["bad.spam.io"]["high"] - rep["bad.spam.io"]["low"]
    assert judge_urls(df.limit(0), lab.limit(0), rules).count() == 0 and judge_urls(df, lab.limit(0), rules).count() == len(pages)


# line spread

def test_lines_on_many_sites_go_but_for_one(spark):
    rows = [(i, f"own {i}\n  Share this page \n\nlast {i}", f"s{i % 5}") for i in range(10)] + [(20, None, "s1"), (21, "", "s2"), (None, "Share this page", "s9"), (22, "twice\ntwice", None), (22, "twice\ntwice", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    out = {(r["doc_id"], i): r for i, r in enumerate(dedup_lines(df, min_sites=5).orderBy("doc_id").collect())}
    by = collections.defaultdict(list)
    for (d, _), r in out.items():
        by[d].append(r)
    assert by[0][0]["text"] == rows[0][1] and by[0][0]["n_removed"] == 0
    assert all(by[i][0]["text"] == f"own {i}\n\nlast {i}" and (by[i][0]["n_lines"], by[i][0]["n_removed"]) == (3, 1) for i in range(1, 10))
    assert by[None][0]["text"] == "Share this page" and by[20][0]["text"] is None and by[21][0]["text"] == "" and [r["text"] for r in by[22]] == ["twice\ntwice"] * 2
    assert dedup_lines(df.limit(0)).count() == 0
    assert dedup_lines(df, min_sites=5, keep_first=False).where("doc_id = 0").first()["n_removed"] == 1


# quality

def test_quality_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in Q.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in Q.QUERIES["op4_pu_quality"](spark, "/root/testdata/sf0.01").collect()]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "some words here"), (3, "x " * 60_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert score_quality(docs, labels).count() == 4 and score_quality(docs, labels.limit(0)).count() == 4 and score_quality(docs.limit(0), labels).count() == 0
    assert keep_good(docs, labels).columns == docs.columns


# personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_strict_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice(rng.choice(["a.@b-", "0123456789", ".1.2", "+1 (0)-", "é@._a "])) for _ in range(rng.randrange(0, 40)))
        assert strict_spans(t) == plain_spans(t)


def test_personal_data_query_keeps_base_spans(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in Q.table(spark, SF, "documents").collect()}
    for r in Q.QUERIES["op3_weak_pii"](spark, SF).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in plain_spans(docs[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone")]


def test_votes_find_written_out_data_and_leave_plain_text(spark):
    said = ["write to john.doe [at] mail [dot] com now", "call me (555) 123-4567 today", "contact jane at example dot org please", "mail a@b.com phone +1 (377) 555-0271 card 4111 1111 1111 1111"] * 3
    clean = ["version 1.2.3.400 is out", "order 1234 5678 9012 3456", "he was at home. com is", "on 2020-01-02 and 1999", "isbn 978 3 16 148410 0"]
    rows = list(enumerate(said + clean)) + [(99, None), (99, ""), (None, "1" * 50_000)]
    out = {r["doc_id"]: r["spans"] for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == "email:9:37" and out[1] == "phone:8:22" and out[2].startswith("email:8:") and out[3].count(":") == 6
    assert all(out[len(said) + i] == "" for i in range(len(clean))) and out[99] == "" == out[None]
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("form", ["jane@example dot com", "jane@example[dot]com", "jane @example.com", "jane@ example.com", "jane [ @ ] example.com", "jane{at} example (.) com", "jane(AT )example DOT com"])
def test_every_loose_address_is_a_candidate(spark, form):
    from visitframe.llm.weak_pii import candidates
    t = f"Please contact {form}, thanks"
    assert candidates(t, strict_spans(t)) == [("email", 15, 15 + len(form), False)]
    rows = [(0, t)] + [(i, "write to john.doe [at] mail [dot] com now") for i in range(1, 5)]
    spans = {r["doc_id"]: r["spans"] for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[0] == f"email:15:{15 + len(form)}"


def test_positive_unlabelled_risk_is_minimal(spark):
    from visitframe.llm.pu_quality import document_features, fit_pu, training_labels
    good = training_labels(Q.table(spark, SF, "labels"))
    marked = document_features(Q.table(spark, SF, "documents"), "doc_id", "text").join(good, "doc_id", "left").select("x", F.coalesce("good", F.lit(False)).alias("positive"))
    marked = stage(marked, "test-quality")
    prior, ridge = 0.3, 0.1
    model = fit_pu(marked, prior, ridge)
    rows = marked.collect()
    raw = np.array([r["x"] for r in rows])
    positive = np.array([r["positive"] for r in rows])
    x = np.column_stack([np.ones(len(raw)), model.inputs(raw.astype(np.float32))])
    keep = np.concatenate([[0.0], np.full(raw.shape[1], ridge)])

    def risk(w):
        z = x @ w
        return np.logaddexp(0, z).mean() - prior * z[positive].mean() + 0.5 * (keep * w**2).sum()

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = (x * p[:, None]).mean(0) - prior * x[positive].mean(0) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(keep + 1e-9), g)
        t = 1.0
        while risk(w - t * step) > risk(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    least = np.logaddexp(0, x @ w).mean() - prior * np.logaddexp(0, x @ w)[positive].mean()
    assert model.settled and least >= 0 and risk(w) - 1e-12 <= risk(model.weight) < risk(w) + 1e-4
    cut = fit_pu(marked, prior, ridge, max_steps=1)  # out of steps: the best so far, no error
    start = np.concatenate([[np.log(prior / (1 - prior))], np.zeros(raw.shape[1])])
    assert not cut.settled and risk(cut.weight) <= risk(start) + 1e-12


def plain_candidates(text):
    """Every loose match in the order of the kinds, left out if it meets any span before it."""
    out = [(k, a, b, True) for k, a, b in strict_spans(text)]
    for kind, pattern, least, most in (("email", weak_pii.LOOSE_EMAIL, 0, 10**9), ("phone", weak_pii.LOOSE_PHONE, 9, 15), ("ip", weak_pii.IP, 0, 10**9), ("card", weak_pii.CARD, 13, 19)):
        for m in pattern.finditer(text):
            if least <= sum(c in "0123456789" for c in m[0]) <= most and not any(a < m.end() and m.start() < b for _, a, b, _ in out):
                out.append((kind, m.start(), m.end(), False))
    return out


def test_candidates_equal_a_plain_search():
    rng = random.Random(2)
    parts = ["jo at ex dot org ", "(030) 1234 5678", "1.2.3.4", "1.2.3.400", "4111 1111 1111 1111", "4111-1111 1111 1112", "+1 377 555 0271", "a.b@c.de", " ", ",", "x", "00 ", "12 "]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
        assert weak_pii.candidates(t, strict_spans(t)) == plain_candidates(t), t


@pytest.mark.parametrize("unit", ["1.", "(030) 1234 5678 ", "a@b.c ", "jo at ex dot org ", "1-"])
def test_candidates_of_a_long_text_take_linear_time(unit):
    t = unit * (1_000_000 // len(unit))
    start = time.process_time()
    weak_pii.candidates(t, strict_spans(t))
    assert time.process_time() - start < 8  # some 0.5 s; a search of all spans for each took minutes


def test_added_spans_equal_a_plain_run(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in Q.table(spark, SF, "documents").collect()}
    seen = collections.Counter((k, weak_pii.votes(t, k, a, b, s), weak_pii.span_features(t, k, a, b, s)) for t in docs.values() for k, a, b, s in plain_candidates(t))
    belief = {}
    for kind in weak_pii.KINDS:
        counts = collections.Counter()
        for (k, v, _), n in seen.items():
            counts[v] += n if k == kind else 0
        counts = collections.Counter({v: n for v, n in counts.items() if n})
        belief |= {(kind, v): p for v, p in aggregate_votes(counts)[0].items()} if counts else {}
    x = np.array([f for _, _, f in seen], float)
    weight = weak_pii.fit_classifier(x, np.array([belief[k, v] for k, v, _ in seen]), np.array(list(seen.values()), float))
    for r in Q.QUERIES["op3_weak_pii"](spark, SF).collect():
        t = docs[r["doc_id"]]
        odds = [(k, a, b, s or float(weight @ np.array(weak_pii.span_features(t, k, a, b, s), float))) for k, a, b, s in plain_candidates(t)]
        want = {f"{k}:{a}:{b}" for k, a, b, z in odds if z is True or z >= 0}
        close = {f"{k}:{a}:{b}" for k, a, b, z in odds if z is not True and abs(z) < 1e-6}
        assert (want ^ set(filter(None, r["spans"].split(",")))) <= close


def test_expectation_maximisation_trusts_agreeing_labelers():
    post, reliability, prior = aggregate_votes({(1, 1, 1, 1): 50, (1, 1, -1, 1): 40, (-1, -1, 1, -1): 60, (-1, -1, -1, -1): 50})
    assert post[1, 1, -1, 1] > 0.99 and post[-1, -1, 1, -1] < 0.01 and 0.4 < prior < 0.5
    assert reliability[0][1][2] > reliability[2][1][2]


# templates

def test_template_round_trips():
    rng, template = random.Random(1), compile_template(DEFAULT)
    bits = ["<", "<s>", "</s>", "[INST]", "[/INST]", "\\", "/", "s>", "[", "INST]", " ", "a", "<<SYS>>", "<</SYS>>", "[ROLE]", "é", "\n"]
    for _ in range(3000):
        turns = [{"role": rng.choice(["user", "assistant", "system", "tool", "", "x</s>"]), "text": "".join(rng.choice(bits) for _ in range(rng.randrange(0, 8)))} for _ in range(rng.randrange(1, 5))]
        text, spans = render(template, messages=turns)
        assert list(Reader().feed(text)) == [(m["role"], m["text"]) for m in turns]
        assert [unescape(text[a:b]) for a, b in spans] == [m["text"] for m in turns if m["role"] == "assistant" and m["text"]]
    assert "</s>" not in escaper()("a</s>b")


def test_template_language():
    tree = fold_block(parse("a{{ 'x' ~ 1+2 }}{% if 1 == 2 %}no{% else %}yes{% endif %}"))
    assert len(tree) == 1 and tree[0].value.value == "ax3yes"
    source = "{%- for m in messages -%} {{ loop.index }}{{ m['text']|trim|upper if m.role in 'users' and not loop.last else 'z' }} {%- endfor -%}"
    assert render(compile_template(source), messages=[{"role": "user", "text": " a"}, {"role": "user", "text": "b"}])[0] == "1A2z"
    assert render(compile_template("{% set a = 2 * 3 %}{{ a - 1 }}{# no #}{{ missing | default('d') }}"))[0] == "5d"
    for bad in ("{{ x.__class__.__mro__ }}", "{{ f(1) }}", "{% import os %}", "{{ x | nothing }}", "{% if a %}", "{{ 'a' * 1000000 }}"):
        with pytest.raises(TemplateError):
            render(compile_template(bad), x=3)


def test_format_query(spark):
    convs = collections.defaultdict(list)
    for r in Q.table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        convs[r["conv_id"]].append((r["role"], r["text"] or ""))
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = {r["conv_id"]: r for r in Q.QUERIES["op5_chat_template"](spark, SF).collect()}
    assert set(rows) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = rows[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r["formatted_chars"] > sum(len(t) for _, t in turns)
    odd = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 1, "assistant", "x"), (2, None, "user", "y" * 100_000)], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in format_digests(odd.withColumn("n_turns", F.lit(1))).collect()}
    assert out == {1: (3, 0), None: (1, 1), 2: (1, 0)} and format_digests(odd.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "decimal(12,2)", "double", "string", "date"])
def test_templates_take_ids_of_any_type(spark, kind):
    cast = F.date_add(F.lit("2020-01-01").cast("date"), F.col("conv_id").cast("int")) if kind == "date" else F.col("conv_id").cast(kind)
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bc"), (2, 0, "user", "d"), (None, 0, "user", "e")], "conv_id long, turn int, role string, text string")
    out = format_digests(rows.withColumn("conv_id", cast))
    assert out.schema["conv_id"].dataType.simpleString() == kind and sorted((r["n_turns"], r["loss_chars"]) for r in out.collect()) == [(1, 0), (1, 0), (2, 2)]


def test_templates_take_ids_that_are_not_a_number(spark):
    rows = spark.createDataFrame([(float("nan"), 0, "user", "a"), (float("nan"), 1, "assistant", "bc"), (1.0, 0, "user", "d")], "conv_id double, turn int, role string, text string")
    assert sorted((r["n_turns"], r["loss_chars"]) for r in format_digests(rows).collect()) == [(1, 0), (2, 2)]


# fingerprints

def test_prefix_hashes_compare_spans():
    rng = random.Random(2)
    for _ in range(150):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) for _ in range(2))
        x, y = PrefixHashes(code_points(a)), PrefixHashes(code_points(b))
        i, j = (np.array([rng.randrange(len(t)) for _ in range(5)]) for t in (a, b))
        want = [next((k for k in range(60) if a[p + k: p + k + 1] != b[q + k: q + k + 1] or p + k >= len(a)), 0) for p, q in zip(i, j)]
        assert x.common_extension(i, y, j).tolist() == want
        half = len(a) // 2
        assert (Windows(a).joined_sketch(len(a) - half, Windows(b), min(half, len(b))) == Windows(edited(a, b)).sketch()).all()
    assert likeness(Windows("").sketch(), Windows("").sketch()) == 1.0 and likeness(Windows("a").sketch(), Windows("").sketch()) == 0.0


def test_common_parts_of_neighbours_are_exact(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["", "aaaa", "aaaa", "aa", "é" * 9]
    long = "".join(rng.choice("abcdefgh") for _ in range(150_000))
    texts += [long[:140_000] + "X" + long[140_001:], long, "Y" + long[1:]]
    rows = list(enumerate(texts)) + [(None, "abab")]

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    got = {r["doc_id"]: r for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    for i, t in rows:
        after = "" if i is None else texts[i - 1]
        e, seam = edited(t, after), t[len(t) - len(t) // 2:]
        want = (shared(t, e), shared(t[::-1], e[::-1]), shared(t, after), shared(t[::-1], after[::-1]), shared(seam, after))
        assert tuple(got[i][k] for k in ("edited_prefix", "edited_suffix", "next_prefix", "next_suffix", "seam")) == want


@pytest.mark.parametrize("ranges", [1, 7])
def test_fingerprint_rows(spark, ranges):
    docs = Q.table(spark, SF, "documents")
    texts = [(r["doc_id"], r["text"] or "") for r in docs.orderBy(F.desc("doc_id")).collect()]
    rows = {r["doc_id"]: r for r in fingerprint_documents(docs.withColumn("b", F.lit(1)), ranges).collect()}
    assert len(rows) == len(texts)
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        e, r = edited(t, after), rows[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["near_edited"] == likeness(Windows(t).sketch(), Windows(e).sketch()) and r["near_next"] == likeness(Windows(t).sketch(), Windows(after).sketch())
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.97
    odd = spark.createDataFrame([(1, "same"), (1, "same"), (None, "lost"), (2, None), (5, "z" * 200_000)], "doc_id long, text string")
    out = fingerprint_documents(odd, ranges).collect()
    assert len(out) == 5 and len({r["fingerprint"] for r in out if r["doc_id"] == 1}) == 1 and fingerprint_documents(odd.limit(0), ranges).count() == 0


# language model

def test_language_model(spark):
    docs = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) + [None] for r in Q.table(spark, SF, "documents").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = collections.Counter(t for d, ts in docs.items() if not held[d] for t in ts)
    n, v = sum(c.values()), len(c)
    base = model = 0
    for r in Q.QUERIES["op10_maxent_lm"](spark, SF).collect():
        ts = docs[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ts), sum(c[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel=1e-9)
        if r["held_out"]:
            base, model = base + r["base_score"], model + r["score"]
    assert model > base


def test_language_model_edge_rows(spark, monkeypatch):
    from visitframe.llm import maxent_lm as M
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b a"), (3, "a b c " * 20_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = score_documents(docs).collect()
    assert len(rows) == 5 and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert score_documents(docs.limit(0)).count() == 0
    whole = {r["doc_id"]: r["base_score"] for r in score_documents(Q.table(spark, SF, "documents")).collect()}
    monkeypatch.setattr(M, "TABLE", 50)  # nearly all words through the join
    monkeypatch.setattr(M, "HEAD", 50)
    for r in score_documents(Q.table(spark, SF, "documents")).collect():
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]], rel=1e-9) and math.isfinite(r["score"])


def test_words_of_one_class_depend_on_the_history(spark, monkeypatch):
    """Every key has its own value; keys and values beyond the few most frequent words share their spelling classes."""
    from visitframe.llm import maxent_lm as M
    monkeypatch.setattr(M, "HEAD", 50)
    rng = random.Random(5)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, " ".join(f"k{j}x v{j}y" for j in rng.sample(range(300), 150))) for i in range(100, 500)]
    some = range(0, 300, 3)
    rows += [(held[0], " ".join(f"k{j}x v{j}y" for j in some)), (held[1], " ".join(f"k{j}x v{(j + 3) % 300}y" for j in some))]
    score = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert score[held[0]] > score[held[1]] + 0.5 * len(some)


def test_most_frequent_words_fill_the_table(spark):
    from visitframe.llm import maxent_lm as M
    rng = random.Random(2)
    rows = [(rng.getrandbits(64) - 2**63, 9 if i < 10 else 5) for i in range(2000)]
    counts = spark.createDataFrame(rows, "h long, c long")
    want = sorted(((c, h % 2**64) for h, c in rows), key=lambda r: (-r[0], r[1]))
    for most in (5, 10, 100, 1999, 2000, 3000):
        h, c = M.most_frequent(counts, most)
        assert list(zip(c.tolist(), h.tolist())) == want[:most]
    assert len(M.most_frequent(counts.limit(0), 7)[0]) == 0


def test_word_trees_are_proper_distributions():
    from visitframe.llm import maxent_lm as M
    rng = np.random.default_rng(3)
    cls, counts = rng.integers(0, 4, 500), rng.integers(1, 1000, 500)
    cls[cls == 3] = M.WIDTH - 1
    tree = M.word_trees(cls, counts)
    blocks = rng.normal(size=(512, M.FAN)).astype(np.float32)
    model = M.ClassModel(M.WordTable(np.arange(500, dtype=np.uint64)), cls, tree, np.zeros((512, M.WIDTH), np.float32), np.zeros_like(blocks))
    keys = np.tile(rng.integers(0, 2**63, (1, 4)).astype(np.uint64), (500, 1))
    p = np.exp(model.log_word(keys, np.arange(500)))
    assert p == pytest.approx(counts / np.bincount(cls, weights=counts)[cls], rel=1e-4)
    model.blocks = blocks
    q = np.exp(model.log_word(keys, np.arange(500)))
    assert np.bincount(cls, weights=q)[np.unique(cls)] == pytest.approx(1, rel=1e-4) and np.abs(np.log(q / p)).max() > 0.5


# pipeline

def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_pipeline_stages(spark):
    docs = Q.table(spark, SF, "documents")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, SF), name)
        if name != "pieces":
            assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    good = {r["doc_id"] for r in score_quality(Q.table(spark, SF, "documents"), Q.table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in seen["quality"][1].collect()} == good
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in seen["near_dedup"])
    ids = sorted(before)
    sets = {d: shingles(before[d]) for d in ids}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, x in enumerate(ids):
        for y in ids[:i]:
            a, b = sets[x], sets[y]
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    assert set(after) == {d for d in ids if find(d) == d}
    bad = {r["doc_id"] for r in verdict(find_contamination(seen["decontamination"][0], Q.table(spark, SF, "benchmark"))).where("contaminated").collect()}
    assert {r["doc_id"] for r in seen["decontamination"][1].collect()} == set(after) - bad
    assert corpus_pipeline.run(spark, SF).count() == docs.count() == len(set(after) - bad)
