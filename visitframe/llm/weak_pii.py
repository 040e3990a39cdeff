"""Personal data by weak supervision.

Four kinds (email, ip, card, phone) have strict patterns whose spans always stay.
Looser candidates (written-out addresses, numbers without a plus sign, numbers
that fail a check) are voted on by labelers: the strict pattern, a gazetteer of
endings and prefixes, the words before the candidate, and its shape. A vote is
+1, -1 or 0 (none). Spark counts vote patterns over all texts; expectation-
maximisation on these counts (at most 3^4 per kind) estimates how reliable each
labeler is and how likely each pattern is personal data. Those probabilities
train the final classifier, a logistic regression on yes/no features of the
span and its surroundings, again from pattern counts. It decides on every
candidate that is not a strict span already.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always begins at the start of its digits, so later starts need no try
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRACE = re.compile(r"[0-9@]")

LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| (?:at|AT) | ?@ ?)"
                         r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63})+")
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")
# stands in every text in which LOOSE_EMAIL can match
WRITTEN = re.compile(r"@|[\[({ ](?:at|AT)[\])} ]")

#: gazetteers: common endings of addresses, first digits of card networks, words that come before each kind
TOP_DOMAINS = frozenset("com org net edu gov info biz io co uk de fr es it nl eu us ca au ch at be se no dk pl pt br jp cn ru in mx ar".split())
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "6011", "65", "35", "36", "62")
BEFORE = {
    "email": ("mail", "contact", "write", "reach", "schreib", "kontakt", "correo", "courriel", "address", "adresse"),
    "ip": ("ip", "host", "server", "login", "address", "client", "from"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment", "paid"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "sms", "handy", "ring", "llama", "appel"),
}
AGAINST = ("version", "isbn", "doi", "order", "page", "release", "rfc", "issn", "section", "figure", "table", "sha", "build")
REACH = 32

#: pseudo-votes -1, 0, +1 of a labeler on candidates that are not, and that are, personal data. A failed check digit or
#: an impossible address part weighs much more than the other votes.
START = {None: [[6, 3, 1], [1, 3, 6]], "pattern": [[600, 300, 1], [1, 300, 600]]}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def strict_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strict patterns by kind and start, leftmost and without overlap inside a kind."""
    if not TRACE.search(text):
        return []
    out, end, past = [], 0, 0
    for m in AT_DOMAIN.finditer(text):
        # what stands before the sign belongs to the address as far as no earlier address took it
        lo = max(end, text.rfind("@", past, m.start()) + 1)
        start = lo + len(text[lo: m.start()].rstrip(LOCAL))
        past = m.start()
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _apart(found: list[re.Match], taken: list[tuple[int, int]]) -> list[re.Match]:
    """Matches that meet no taken span; both lists ascend and neither overlaps itself, so one sweep does."""
    out, i = [], 0
    for m in found:
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            out.append(m)
    return out


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in ascending order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, strict: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """Strict spans and looser ones (kind, start, end, strict); a loose one that meets a strict span is left out.

    So is one that meets a loose span of a kind before it. Each kind is one sweep over the sorted spans taken so far,
    so a text costs in proportion to its length and the sort of its spans.
    """
    out = [(k, a, b, True) for k, a, b in strict]
    taken = _covered([(a, b) for _, a, b in strict])
    loose: list[tuple[str, list[re.Match]]] = []
    if WRITTEN.search(text):
        loose.append(("email", list(LOOSE_EMAIL.finditer(text))))
    if TRACE.search(text):
        loose.append(("phone", [m for m in LOOSE_PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]))
        loose.append(("ip", list(IP.finditer(text))))
        loose.append(("card", [m for m in CARD.finditer(text) if 13 <= len(digits_of(m[0])) <= 19]))
    for kind, found in loose:
        new = _apart(found, taken)
        if new:
            out += [(kind, m.start(), m.end(), False) for m in new]
            taken = _covered(taken + [m.span() for m in new])
    return out


def _before(text: str, start: int) -> str:
    return text[max(0, start - REACH): start].lower()


def _listed(kind: str, span: str) -> bool:
    d = digits_of(span)
    if kind == "email":
        return re.split(r"[^A-Za-z0-9-]+", span.rstrip(" ])}"))[-1].lower() in TOP_DOMAINS
    if kind == "card":
        return d.startswith(CARD_PREFIXES)
    if kind == "phone":
        return span.startswith(("+", "00", "(")) and not d.startswith("000")
    return not d.startswith("0")


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """One vote per labeler."""
    span, words = text[start:end], re.findall(r"[^\W\d_]+", _before(text, start))
    d = digits_of(span)
    pattern = 1 if strict else -1 if kind in ("ip", "card") else 0
    gazetteer = 1 if _listed(kind, span) else -1
    context = 1 if any(w.startswith(BEFORE[kind]) for w in words[-4:]) else -1 if any(w in AGAINST for w in words[-4:]) else 0
    if kind == "email":
        shape = 1 if re.search(r"[A-Za-z]", span) and "  " not in span else -1
        if not strict and re.search(r" (?:at|AT) ", span) and not re.search(r"dot|DOT|[\[({]", span):
            shape = -1  # an ordinary sentence with a domain in it
    else:
        shape = -1 if len(set(d)) <= 2 or d in "01234567890123456789" else 1 if len(set(re.findall(r"[^0-9]", span.strip("+")))) <= 4 else 0
    return pattern, gazetteer, context, shape


FEATURES = ("bias", "email", "ip", "card", "phone", "strict", "listed", "told before", "told against", "few digits", "letters", "blanks", "brackets", "plus", "long", "joined left", "joined right", "written out")


def span_features(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    span, words = text[start:end], re.findall(r"[^\W\d_]+", _before(text, start))
    return tuple(int(bool(x)) for x in (
        True, kind == "email", kind == "ip", kind == "card", kind == "phone", strict, _listed(kind, span), any(w.startswith(BEFORE[kind]) for w in words[-4:]),
        any(w in AGAINST for w in words[-4:]), len(set(digits_of(span))) <= 2, re.search("[A-Za-z]", span), " " in span, re.search(r"[\[({]", span), span[:1] == "+",
        end - start > 24, start > 0 and text[start - 1].isalnum(), end < len(text) and text[end].isalnum(), kind == "email" and "@" not in span))


@dataclass
class Weights:
    """Reliabilities by kind and labeler, and the weights of the span classifier."""

    reliability: dict[str, list[list[list[float]]]]  # kind -> labeler -> truth 0/1 -> P(vote -1, 0, +1)
    prior: dict[str, float]
    weight: np.ndarray

    def score(self, f: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-(self.weight @ np.array(f, float)))))


def aggregate_votes(counts: dict[tuple[int, ...], float], tol: float = 1e-8, max_rounds: int = 10_000) -> tuple[dict, list, float]:
    """Expectation-maximisation for one kind: P(personal | votes) of each pattern, reliabilities, prior.

    Starts from labelers that are mostly right (`START`), which stay in the counts as pseudo-votes, so that few
    candidates cannot turn a labeler round. Rounds end when no probability moves by `tol`.
    """
    patterns = np.array(list(counts), int) + 1
    n = np.array([counts[k] for k in counts], float)
    start = np.array([START.get(name, START[None]) for name in LABELERS])
    rel, prior, before = start / start.sum(2, keepdims=True), 0.5, None
    for _ in range(max_rounds):
        like = np.stack([np.prod([rel[j, y, patterns[:, j]] for j in range(patterns.shape[1])], 0) for y in (0, 1)])
        like *= np.array([[1 - prior], [prior]])
        post = like[1] / like.sum(0)
        if before is not None and np.abs(post - before).max() < tol:
            break
        before = post
        prior = (n @ post + 1) / (n.sum() + 2)
        for j in range(patterns.shape[1]):
            for y, p in ((0, 1 - post), (1, post)):
                rel[j, y] = np.bincount(patterns[:, j], weights=n * p, minlength=3) + start[j, y]
                rel[j, y] /= rel[j, y].sum()
    return dict(zip(counts, post.tolist())), rel.tolist(), float(prior)


def fit_classifier(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on weighted patterns with soft labels, by damped Newton steps."""
    w = np.zeros(x.shape[1])

    def risk(v):
        z = x @ v
        return float(n @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge * v @ v)

    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (n * (p - y)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        if abs(g @ step) < 1e-10:
            break
        t = 1.0
        while risk(w - t * step) > risk(w) and t > 1e-6:
            t /= 2
        w = w - t * step
    return w


def _texts(batch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def _count_task(batches):
    seen: Counter = Counter()
    for batch in batches:
        for t in _texts(batch):
            for kind, a, b, strict in candidates(t, strict_spans(t)):
                seen[kind, votes(t, kind, a, b, strict), span_features(t, kind, a, b, strict)] += 1
    kinds, vote, feat = ([k[i] for k in seen] for i in range(3))
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([list(v) for v in vote], pa.list_(pa.int32())), pa.array([list(f) for f in feat], pa.list_(pa.int32())),
                                      pa.array(list(seen.values()), pa.int64())], names=["kind", "votes", "features", "n"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Counts of (kind, votes, features) over all texts, at most 3^4 times 2^17 whatever their number; then both models."""
    rows = (docs.select(id_col, text_col).mapInArrow(_count_task, "kind string, votes array<int>, features array<int>, n long")
            .groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect())
    belief, reliability, prior = {}, {}, {}
    for kind in KINDS:
        counts: Counter = Counter()
        for r in rows:
            if r["kind"] == kind:
                counts[tuple(r["votes"])] += r["n"]
        if counts:
            found, reliability[kind], prior[kind] = aggregate_votes(counts)
            belief |= {(kind, v): p for v, p in found.items()}
    if not rows:
        return Weights({}, {}, np.concatenate([[-10.0], np.zeros(len(FEATURES) - 1)]))
    x = np.array([r["features"] for r in rows], float)
    y = np.array([belief[r["kind"], tuple(r["votes"])] for r in rows])
    return Weights(reliability, prior, fit_classifier(x, y, np.array([r["n"] for r in rows], float)))


def all_spans(text: str, weights: Weights, least: float = 0.5) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(strict spans, all spans), each by kind as listed, then start."""
    strict, known, more = strict_spans(text), {}, []
    for k, a, b, s in candidates(text, strict):
        if not s:
            f = span_features(text, k, a, b, s)
            if f not in known:
                known[f] = weights.score(f)
            if known[f] >= least:
                more.append((k, a, b))
    return strict, sorted(strict + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, weights: Weights | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of strict spans by kind, their digest, and all spans as `kind:start:end` in code points.

    A null text is an empty one and has no spans; repeated rows and null ids give rows of their own.
    """
    weights = weights or learn(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches):
        for batch in batches:
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for t in _texts(batch):
                strict, every = all_spans(t, weights)
                tally = Counter(s[0] for s in strict)
                for k in KINDS:
                    counts[k].append(tally[k])
                digests.append(hashlib.sha256(spans_text(strict).encode()).hexdigest())
                spans.append(spans_text(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                                             names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(task, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
