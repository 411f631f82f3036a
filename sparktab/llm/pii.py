"""Personal data by weak supervision.

Candidate spans come from the contract's patterns and from looser shapes.  Five
labelers (pattern check, format rules, gazetteers, words around the span, edges
of the span) vote yes, no or abstain.  Expectation-maximisation over the counts
of vote patterns estimates each labeler's reliability per kind; its posteriors
train a logistic span classifier on features of the span.  Spans of the
contract's patterns always stay, other candidates stay if the classifier accepts.

Votes and features are small discrete codes, so what the fit sees is a table
(kind, votes, features) → count over all documents, whose size is bounded by
the number of codes and not by the data."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spans, sha256_hex, text_frame

ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3}
KINDS = list(ORDER)

# The contract's patterns.  The e-mail pattern is matched from its
# "@" outwards, and a dotted number cannot start inside a run of digits, which
# gives the same leftmost matches in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser shapes.
SPELT_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\x20?(?:\[at\]|\(at\)|\{at\})\x20?"
                         r"([A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63})+)", re.I | re.A)
IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io ai app dev co us uk de fr es it nl be ch at se no dk "
                        "fi pl pt cz ie eu ru ua tr gr ro hu ca mx br ar cl jp cn kr in au nz za".split())
CARD_ISSUERS = {"34": (15,), "37": (15,), "4": (13, 16, 19), "5": (16,), "2": (16,), "6": (16, 17, 18, 19), "35": (16,),
                "30": (14,), "36": (14,), "38": (14,)}
NEAR = {"email": ("mail", "contact", "write", "reach", "schreib", "correo", "courriel"),
        "ip": ("ip", "host", "server", "address", "login", "network"),
        "card": ("card", "visa", "master", "credit", "payment", "pay", "karte", "tarjeta", "carte"),
        "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "contact", "ruf")}
FAR = ("version", "order", "invoice", "isbn", "page", "build", "release", "chapter", "section", "ticket", "serial")

LABELERS = ("pattern", "format", "gazetteer", "context", "edges")
NO, ABSTAIN, YES = 0, 1, 2
#: Values of each feature; their product bounds the codes.
SIZES = {"length": 6, "separators": 5, "before": 3, "after": 3, "near": 3, "groups": 5,
         "format": 3, "gazetteer": 3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: int
    features: int


def _shapes(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passes the contract) of every candidate."""
    if "@" in text:
        yield from (("email", s, e, True) for s, e in emails(text))
    low = text.lower()
    if "at]" in low or "at)" in low or "at}" in low:
        yield from (("email", *m.span(), False) for m in SPELT_EMAIL.finditer(text))
    if ":" in text:
        yield from (("ip", *m.span(), False) for m in IP6.finditer(text))
    if not any(d in text for d in "0123456789"):
        return
    for m in IP.finditer(text):
        yield "ip", *m.span(), all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19:
            yield "card", *m.span(), luhn(digits)
    yield from (("card", *m.span(), False) for m in DOTTED_CARD.finditer(text))
    for m in PHONE.finditer(text):
        yield "phone", *m.span(), 9 <= sum(map(str.isdigit, m[0])) <= 15
    yield from (("phone", *m.span(), False) for m in LOCAL_PHONE.finditer(text))


def _edge(c: str) -> int:
    return 0 if not c or c.isspace() else 2 if c.isalnum() else 1


def _gazetteer(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return YES if re.split(r"[^A-Za-z0-9]+", span.lower())[-1] in TOP_DOMAINS else NO
    if kind == "card":
        return YES if any(digits.startswith(p) and len(digits) in n for p, n in CARD_ISSUERS.items()) else NO
    if kind == "ip":
        first = digits and span.split(".")[0].lstrip("0") or "0"
        return NO if ":" not in span and (first == "0" or len(first) > 3 or int(first) > 223) else YES
    return YES if span[0] == "+" and span[1] != "0" else ABSTAIN


def _format(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        local = re.split(r"@|\[at\]|\(at\)|\{at\}", span, flags=re.I)[0]
        return NO if local.startswith(".") or ".." in span or len(local) > 64 else YES
    if kind == "ip":
        return YES if ":" in span or all(p == "0" or not p.startswith("0") for p in span.split(".")) else NO
    if kind == "card":
        return YES if luhn(digits) else NO
    return YES if 7 <= len(digits) <= 15 and len(set(digits)) > 2 else NO


def candidates(text: str) -> list[Candidate]:
    """Every candidate of a text with its votes and features; a looser one that
    overlaps a span of the contract is left out."""
    found = list(_shapes(text))
    if not found:
        return []
    taken = sorted((s, e) for _, s, e, base in found if base)
    starts = [s for s, _ in taken]
    furthest = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
    out = []
    for kind, s, e, base in found:
        if not base:
            i = int(np.searchsorted(starts, e, "left"))
            if i and furthest[i - 1] > s:
                continue
        span = text[s:e]
        digits = re.sub("[^0-9]", "", span)
        around = text[max(0, s - 40):s].lower()
        near = YES if any(w in around for w in NEAR[kind]) else NO if any(w in around for w in FAR) else ABSTAIN
        before, after = _edge(text[s - 1:s]), _edge(text[e:e + 1])
        form, listed = _format(kind, span, digits), _gazetteer(kind, span, digits)
        votes = (YES if base else NO if kind in ("ip", "card") and ":" not in span else ABSTAIN, form, listed, near,
                 NO if before == 2 or after == 2 else ABSTAIN)
        marks = {c for c in span if not c.isalnum()} - {"+", "@", "(", ")"}
        groups = len(re.findall("[0-9]+", span))
        values = (min(5, (e - s) // 6), 0 if not marks else 4 if len(marks) > 1 else 1 + "- .".find(marks.pop()) % 3,
                  before, after, near, min(4, groups), form, listed)
        code = 0
        for v, n in zip(values, SIZES.values(), strict=True):
            code = code * n + v
        out.append(Candidate(kind, s, e, base, sum(v * 3 ** i for i, v in enumerate(votes)), code))
    return out


def _vote_table(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** i % 3 for i in range(len(LABELERS))], 1)


def _feature_table(codes: np.ndarray) -> np.ndarray:
    """One-hot features with a leading constant."""
    cols, rest = [], codes
    for n in reversed(SIZES.values()):
        cols.append(np.eye(n)[rest % n])
        rest = rest // n
    return np.concatenate([np.ones((len(codes), 1)), *reversed(cols)], 1)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for one kind: (P(vote | class) by class and labeler, posterior of each
    pattern, prior).  Pseudo-counts start the labelers off as better than chance."""
    n = len(LABELERS)
    pseudo = np.empty((2, n, 3))
    pseudo[1], pseudo[0] = (1.0, 2.0, 3.0), (3.0, 2.0, 1.0)
    given, prior = pseudo / pseudo.sum(2, keepdims=True), 0.5
    for _ in range(rounds):
        log = [np.log(p) + sum(np.log(given[c, j, votes[:, j]]) for j in range(n))
               for c, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        prior = (1 + (counts * post).sum()) / (2 + counts.sum())
        for c, w in ((0, counts * (1 - post)), (1, counts * post)):
            seen = np.stack([np.bincount(votes[:, j], w, 3) for j in range(n)]) + pseudo[c]
            given[c] = seen / seen.sum(1, keepdims=True)
    return given, post, float(prior)


def train(x: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (soft - p)) - ridge * w
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """Reliabilities and classifier weights by kind; a kind without candidates has neither."""
    reliability: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]

    def accepts(self, c: Candidate) -> bool:
        if c.base:
            return True
        w = self.weights.get(c.kind)
        return w is not None and float((_feature_table(np.array([c.features])) @ w)[0]) >= 0

    def spans(self, text: str) -> list[Candidate]:
        out, seen = [], set()
        for c in candidates(text):
            if (c.kind, c.start, c.end) not in seen and self.accepts(c):
                seen.add((c.kind, c.start, c.end))
                out.append(c)
        return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Estimate labelers and train the classifier on all candidates of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for t in batch.column(0).to_pylist() for c in candidates(t)]
            seen = pd.Series([(c.kind, c.votes, c.features) for c in found], dtype=object).value_counts()
            cols = list(zip(*seen.index, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                 pa.array(seen.to_numpy(), pa.int64())], ["kind", "votes", "features", "n"])

    rows = text_frame(docs, id_col, text_col).select("text") \
        .mapInArrow(run, "kind string, votes int, features int, n bigint")
    table = rows.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).toPandas() \
        .sort_values(["kind", "votes", "features"])
    model = Model({}, {})
    for kind, t in table.groupby("kind"):
        by_votes = t.groupby("votes", as_index=False)["n"].sum()
        given, post, _ = estimate(_vote_table(by_votes["votes"].to_numpy()), by_votes["n"].to_numpy(float))
        soft = t["votes"].map(dict(zip(by_votes["votes"], post, strict=True))).to_numpy()
        model.reliability[kind] = given
        model.weights[kind] = train(_feature_table(t["features"].to_numpy()), soft, t["n"].to_numpy(float))
    return model


def find_pii(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row.

    Counts and digest cover the contract's spans, ``spans`` all accepted ones.
    Null text counts as empty (no spans); a null id stays null; repeated rows are
    searched one by one; an empty table gives an empty result; very long texts
    are searched whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = [(c.kind, c.start, c.end, c.base) for c in sent.value.spans(text)]
                base = [s[:3] for s in spans if s[3]]
                rows.append((doc_id, *(sum(s[0] == k for s in base) for k in KINDS), sha256_hex(join_spans(base, ORDER)),
                             join_spans([s[:3] for s in spans], ORDER)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return text_frame(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[Candidate]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for c in sorted(spans, key=lambda c: (c.start, ORDER[c.kind])):
        if c.start >= at:
            out += [text[at:c.start], f"[{c.kind.upper()}]"]
        at = max(at, c.end)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in the text replaced by their kinds; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.names.index(text_col)
            texts = [t if t is None else masked(t, sent.value.spans(t)) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
