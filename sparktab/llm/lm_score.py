"""Language-model scores of whole texts: log-bilinear model, noise-contrastive training.

Tokens are words of an ASCII-lower-cased text and one end.  The ``shortlist`` words
that stand most often in the training texts are symbols of their own; any other
word, met or not, belongs to a tail symbol by its last three bytes.  The model

    P(symbol | three symbols before) = softmax(q . Q + b),   q = sum_i R[s_i] C_i

is normalised over all symbols, and a tail word has (c + 1) / (N_t + V_t + 1) of its
symbol t's share, so that every word has a probability.

* Word counts cover all texts; they are one Spark aggregation and grow with the corpus.
* Training reads every training token once: the texts' symbols are written in
  ``rounds`` slices; in a round each task runs minibatches of noise-contrastive
  estimation over its part of the slice, and the parts' weights are averaged by tokens.
* Scoring normalises over all symbols at once, by products of exponentials kept for
  each context place and symbol.  The most frequent words (at most ``frequent``, some 10 MB) go to every task with their counts; a text's other
  words are joined with the count table, which holds no hot key then."""
from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_frame, written

CONTEXT = 3
#: Words longer than this are counted under a digest, so that keys stay small.
LONG_WORD = 40
#: Distinct words a task counts before it hands them on.
FLUSH_WORDS = 400_000
PART_BYTES = 1 << 20
#: Positions trained on or scored in one matrix product.
BATCH, SCORED = 2048, 512
SPACES = b" \t\n\r\x0b\x0c"


def parts(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part; words are never cut."""
    at = 0
    while at < len(data):
        end = at + PART_BYTES
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield data[at:end].lower().split()  # both treat ASCII only
        at = end


def key_of(word: bytes) -> bytes:
    """The word, or a digest that no word can equal, as it starts with a space."""
    if len(word) <= LONG_WORD:
        return word
    import hashlib
    return b" " + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def tail_of(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-3:]) % tails


def held_out(id_col: Column) -> Column:
    """crc32 of the id's text leaves 2 when divided by 7; a null id is a training row."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    column = batch.column(batch.schema.get_field_index(name))
    for at in range(0, batch.num_rows, 256):
        yield from column.slice(at, 256).cast(pa.binary()).to_pylist()


def word_counts(texts: DataFrame, tails: int) -> DataFrame:
    """(word, tail, n_train, n_all) of ``texts`` (text, held_out)."""
    crc32 = zlib.crc32

    def rows(met: Counter, learned: bool) -> pa.RecordBatch:
        n = pa.array(list(met.values()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([w if len(w) <= LONG_WORD else key_of(w) for w in met], pa.binary()),
             pa.array([crc32(w[-3:]) % tails for w in met], pa.int32()),
             n if learned else pa.array(np.zeros(len(met), np.int64)), n],
            ["word", "tail", "n_train", "n_all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()
        for batch in batches:
            for data, out in zip(_texts(batch, "text"), batch.column(1).to_pylist(), strict=True):
                for words in parts(data):
                    (rest if out else train).update(words)
                if len(train) + len(rest) > FLUSH_WORDS:
                    yield rows(train, True)
                    yield rows(rest, False)
                    train, rest = Counter(), Counter()
        yield rows(train, True)
        yield rows(rest, False)

    counted = texts.select("text", "held_out").mapInArrow(run, "word binary, tail int, n_train bigint, n_all bigint")
    return counted.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n_train").alias("n_train"),
                                       F.sum("n_all").alias("n_all"))


@dataclass
class Vocabulary:
    """Symbols and counts: symbol 0 is the end, then the shortlist, then the tails."""
    words: dict[bytes, int]          # frequent word -> place in the arrays below
    symbol: np.ndarray
    count: np.ndarray                # in training tokens
    first_tail: int
    tails: int
    shares: np.ndarray               # training tokens of every symbol
    tail_total: np.ndarray           # N_t + V_t + 1 of every tail
    tokens: int                      # N
    distinct: int                    # V
    ends: int                        # training texts

    def __post_init__(self):
        self.log_count = np.log10(self.count + 1.0)
        self.log_total = np.log10(self.tail_total.astype(np.float64))

    @property
    def size(self) -> int:
        return self.first_tail + self.tails


def learn_vocabulary(counts: DataFrame, ends: int, *, shortlist: int, tails: int, frequent: int) -> Vocabulary:
    """The vocabulary of written word ``counts``; only frequent words and tail sums are collected."""
    rank = F.floor(F.log2("n_all") * 32)
    sizes = counts.groupBy(rank.alias("rank")).count().orderBy(F.desc("rank")).collect()  # some hundred ranks
    least, left = 1 << 30, frequent
    for r in sizes:
        if (left := left - r["count"]) < 0:
            break
        least = r["rank"]
    rows = sorted(((bytes(r["word"]), r["tail"], r["n_train"]) for r in counts.where(rank >= least).select(
        "word", "tail", "n_train").toLocalIterator()), key=lambda r: (-r[2], r[0]))
    named = min(shortlist, sum(r[2] > 0 for r in rows))
    first = 1 + named
    sums = counts.groupBy("tail").agg(F.sum("n_train").alias("n"), F.sum(F.signum("n_train")).cast("long").alias("v"))
    n, v = np.zeros(tails, np.int64), np.zeros(tails, np.int64)
    for r in sums.collect():
        n[r["tail"]], v[r["tail"]] = r["n"], r["v"]
    tokens, distinct = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
    for _, t, c in rows[:named]:
        n[t] -= c
        v[t] -= 1
    symbol = np.array([1 + i if i < named else first + t for i, (_, t, _) in enumerate(rows)], np.int16)
    count = np.array([c for _, _, c in rows], np.int64)
    return Vocabulary({w: i for i, (w, _, _) in enumerate(rows)}, symbol, count, first, tails,
                      np.concatenate([[ends], count[:named], n]), n + v + 1, tokens, distinct, ends)


class Coder(dict):
    """Words as numbers: places in the vocabulary, and beyond these the missing words a task has met."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(vocab.words)
        self.vocab, self.keys, self.symbols = vocab, [], array("h")

    def __missing__(self, word: bytes) -> int:
        key, v = key_of(word), self.vocab
        i = -1 if key is word else v.words.get(key, -1)
        if i < 0:
            i = len(v.symbol) + len(self.keys)
            self.keys.append(key)
            self.symbols.append(v.first_tail + tail_of(word, v.tails))
        self[word] = i
        return i


@dataclass
class Encoded:
    """Texts as symbols, and what scoring needs of them, one place per text."""
    symbols: np.ndarray              # of all texts, each with its end
    ends: np.ndarray                 # where they end there
    words: np.ndarray
    known: np.ndarray                # known tokens
    base: np.ndarray                 # sum of log10(c + 1)
    tail: np.ndarray                 # the tails' part of the score
    missing: tuple[np.ndarray, list[bytes], np.ndarray]  # (where a text's end, words, times)


def encode(texts: Iterable[bytes], coder: Coder) -> Encoded:
    """The texts, encoded together.  ``base`` and ``tail`` lack log10(c + 1) of the missing words, whose
    counts are not at hand."""
    v, places, sizes = coder.vocab, [np.zeros(0, np.int32)], []
    for data in texts:
        sizes.append(0)
        for words in parts(data):
            places.append(np.fromiter(map(coder.__getitem__, words), np.int32, len(words)))
            sizes[-1] += len(words)
    n, at, words = len(sizes), np.concatenate(places), np.array(sizes, np.int64)
    owner, here = np.repeat(np.arange(n), words), at < len(v.symbol)
    ids = np.concatenate([v.symbol, np.array(coder.symbols, np.int16)]).take(at)
    symbols = np.zeros(len(at) + n, np.int16)
    symbols[np.arange(len(at)) + owner] = ids
    met, of = at[here], owner[here]
    known = np.bincount(of[v.count.take(met) > 0], minlength=n) + int(v.ends > 0)
    logs, rare = v.log_count.take(met), ids >= v.first_tail
    base = np.bincount(of, logs, n) + float(np.log10(v.ends + 1.0))
    tail = np.bincount(of, np.where(rare[here], logs, 0.0), n) \
        - np.bincount(owner[rare], v.log_total.take(ids[rare] - v.first_tail), n)
    new = max(len(coder.keys), 1)
    which, times = np.unique(owner[~here] * new + (at[~here] - len(v.symbol)), return_counts=True)
    missing = (np.cumsum(np.bincount(which // new, minlength=n)), [coder.keys[i] for i in (which % new).tolist()], times)
    return Encoded(symbols, np.cumsum(words + 1), words, known, base, tail, missing)


@dataclass
class Model:
    """R: symbols as context, C: one matrix per context place, Q and b: symbols as outcome."""
    R: np.ndarray
    C: np.ndarray
    Q: np.ndarray
    b: np.ndarray

    def __post_init__(self):
        self.tables, self.buffers = None, np.empty((2, 0, len(self.b)), np.float32)

    @classmethod
    def start(cls, shares: np.ndarray, dim: int, seed: int) -> Model:
        """The unigram model: outcome vectors are zero and biases the log shares."""
        r = np.random.default_rng(seed)
        prob = (shares + 1.0) / (shares + 1.0).sum()
        return cls(r.normal(0, 0.5, (len(shares), dim)).astype(np.float32),
                   np.stack([np.eye(dim) / (1 + i) for i in range(CONTEXT)]).astype(np.float32),
                   np.zeros((len(shares), dim), np.float32), np.log(prob).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.R, self.C, self.Q, self.b)])

    def with_weights(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in (self.R, self.C, self.Q, self.b):
            out.append(flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)

    def _fill(self) -> None:
        """What each context place adds to every symbol's score, and its exponential below the row's greatest."""
        parts = [(self.R @ c) @ self.Q.T for c in self.C]
        parts[0] = parts[0] + self.b
        tops = [p.max(1) for p in parts]
        self.tables = parts, tops, [np.exp(p - t[:, None]) for p, t in zip(parts, tops, strict=True)]

    def log_probabilities(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all symbols.

        A score is a sum over the context places, so its exponential is a product of
        rows that are there before: no exponential is taken per position."""
        if self.tables is None:
            self._fill()
        (parts, tops, factors), n = self.tables, len(symbols)
        if self.buffers.shape[1] < n:
            self.buffers = np.empty((2, n, len(self.b)), np.float32)
        product, row = self.buffers[:, :n]
        np.take(factors[0], contexts[:, 0], 0, out=product, mode="clip")
        for i in range(1, CONTEXT - 1):
            product *= np.take(factors[i], contexts[:, i], 0, out=row, mode="clip")
        np.take(factors[-1], contexts[:, -1], 0, out=row, mode="clip")
        total = np.einsum("ij,ij->i", product, row).astype(np.float64)
        own, top = np.zeros(n), np.zeros(n)
        for i in range(CONTEXT):
            own += parts[i][contexts[:, i], symbols]
            top += tops[i].take(contexts[:, i])
        lost = ~(total > 1e-25)  # the places' greatest lie far apart: products may have left the range of floats
        if lost.any():
            scores = sum(parts[i][contexts[lost, i]].astype(np.float64) for i in range(CONTEXT))
            top[lost] = scores.max(1)
            total[lost] = np.exp(scores - top[lost, None]).sum(1)
        return own - top - np.log(total)


def contexts_of(ids: np.ndarray) -> np.ndarray:
    """The symbols before each place, the nearest first; before the text stand ends."""
    padded = np.concatenate([np.zeros(CONTEXT, ids.dtype), ids])
    return np.stack([padded[CONTEXT - 1 - i:len(padded) - 1 - i] for i in range(CONTEXT)], 1)


def _scatter(rows: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """out[rows[i]] += values[i], rows sorted first."""
    order = np.argsort(rows, kind="stable")
    at = rows.take(order)
    starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    out[at.take(starts)] += np.add.reduceat(values.take(order, 0), starts, axis=0)


class Trainer:
    """Minibatch noise-contrastive estimation with AdaGrad steps.

    The noise of a batch is drawn from the symbols' shares and meets all its
    contexts: a symbol's true scores rise against k log-shifted noise scores."""

    def __init__(self, model: Model, shares: np.ndarray, *, noise: int, rate: float, seed: int):
        self.m = Model(*(x.copy() for x in (model.R, model.C, model.Q, model.b)))
        prob = (shares + 1.0) / (shares + 1.0).sum()
        self.cumulated = np.cumsum(prob)
        self.shift = np.log(noise * prob).astype(np.float32)
        self.noise, self.rate, self.random = noise, rate, np.random.default_rng(seed)
        self.squares = [np.full(x.shape, 1e-4, np.float32) for x in (model.R, model.C, model.Q, model.b)]
        self.tokens = 0

    def step(self, ctx: np.ndarray, target: np.ndarray) -> None:
        m, n = self.m, len(target)
        rows = [m.R.take(ctx[:, i], 0) for i in range(CONTEXT)]
        q = rows[0] @ m.C[0]
        for r, c in zip(rows[1:], m.C[1:], strict=True):
            q += r @ c
        drawn = np.minimum(np.searchsorted(self.cumulated, self.random.random(self.noise)), len(m.b) - 1).astype(np.int16)
        out, away = m.Q.take(target, 0), m.Q.take(drawn, 0)
        up = np.einsum("ij,ij->i", q, out)
        up += m.b.take(target) - self.shift.take(target)
        down = q @ away.T
        down += m.b.take(drawn) - self.shift.take(drawn)
        for x in (up, down):  # the logistic function of x, by tanh
            x *= 0.5
            np.tanh(x, out=x)
            x *= 0.5
        np.subtract(0.5, up, out=up)        # 1 - P(data | target)
        np.subtract(-0.5, down, out=down)   # -P(data | noise)
        dq = down @ away
        out *= up[:, None]
        dq += out
        into = [np.zeros_like(x) for x in (m.R, m.C, m.Q, m.b)]
        _scatter(target, up[:, None] * q, into[2])
        _scatter(drawn, down.T @ q, into[2])
        into[3] += np.bincount(target, up, len(m.b)).astype(np.float32)
        into[3] += np.bincount(drawn, down.sum(0), len(m.b)).astype(np.float32)
        for i, r in enumerate(rows):
            into[1][i] = r.T @ dq
            _scatter(ctx[:, i], dq @ m.C[i].T, into[0])
        for x, g, s in zip((m.R, m.C, m.Q, m.b), into, self.squares, strict=True):
            g /= n
            s += g * g
            g *= self.rate
            g /= np.sqrt(s)
            x += g
        self.tokens += n


def _batches(arrays: Iterator[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, symbols) of ``size`` positions; the last ones may be fewer."""
    held, n = [], 0
    for ids in arrays:
        for at in range(0, len(ids), size):  # a slice with the places before it
            before = ids[max(0, at - CONTEXT):at]
            window = np.concatenate([before, ids[at:at + size]])
            held.append((contexts_of(window)[len(before):], window[len(before):]))
            n += len(held[-1][1])
            if n >= size:
                c, t = (np.concatenate(x) for x in zip(*held, strict=True))
                yield c[:size], t[:size]
                held, n = ([(c[size:], t[size:])], n - size) if n > size else ([], 0)
    if n:
        c, t = (np.concatenate(x) for x in zip(*held, strict=True))
        yield c, t


def train(symbols: DataFrame, vocab: Vocabulary, *, dim: int = 16, rounds: int = 8, noise: int = 32,
          rate: float = 0.04, seed: int = 42) -> Model:
    """The model after one pass over the training rows of ``symbols`` (slice, ids)."""
    model = Model.start(vocab.shares, dim, seed)
    sc = symbols.sparkSession.sparkContext
    for r in range(rounds):
        sent = sc.broadcast((model, vocab.shares))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, r=r) -> Iterator[pa.RecordBatch]:
            given, shares = sent.value
            t = Trainer(given, shares, noise=noise, rate=rate, seed=seed + r)
            ids = (np.frombuffer(x.as_buffer(), "<i2") for b in batches for x in b.column(0))
            for c, s in _batches(ids, BATCH):
                t.step(c, s)
            if t.tokens:
                flat = np.append(t.m.flat().astype(np.float64), 1.0) * t.tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                                                 ["place", "weight"])

        sums = symbols.where(F.col("slice") == r).select("ids").mapInArrow(run, "place int, weight double") \
            .groupBy("place").agg(F.sum("weight").alias("weight")).toPandas()  # as many rows as the model has weights
        sent.destroy()
        if len(sums):
            flat = sums.sort_values("place")["weight"].to_numpy()
            model = model.with_weights(flat[:-1] / flat[-1])
    return model


ENCODED = ("row bigint, doc_id bigint, held_out boolean, slice int, ids binary, n_tokens bigint, n_known bigint, "
           "base double, tail double, missing array<struct<word:binary,n:bigint>>")


def _encoded(texts: DataFrame, vocab: Vocabulary, rounds: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                if len(coder.keys) > FLUSH_WORDS:
                    coder = Coder(sent.value)
                part = batch.slice(at, 256)
                coded = encode(_texts(part, "text"), coder)
                out = part.column(2).to_pylist()
                to, words, times = coded.missing
                missing = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
                from_zero = lambda ends, unit=1: pa.array(np.concatenate([[0], ends * unit]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2),
                    pa.array([-1 if o else k for o, k in zip(out, part.column(3).to_pylist(), strict=True)], pa.int32()),
                    pa.Array.from_buffers(pa.binary(), len(out), [None, from_zero(coded.ends, 2).buffers()[1],
                                                                  pa.py_buffer(coded.symbols.astype("<i2"))]),
                    pa.array(coded.words + 1, pa.int64()), pa.array(coded.known, pa.int64()),
                    pa.array(coded.base, pa.float64()), pa.array(coded.tail, pa.float64()),
                    pa.ListArray.from_arrays(from_zero(to), missing)],
                    ["row", "doc_id", "held_out", "slice", "ids", "n_tokens", "n_known", "base", "tail", "missing"])

    dealt = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(rounds)).cast("int")
    return texts.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "held_out",
                        dealt.alias("slice"), "text").mapInArrow(run, ENCODED)


def _scored(symbols: DataFrame, model: Model) -> DataFrame:
    sent = symbols.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), "<i2") for x in batch.column(1)]
            sums, owner = np.zeros(len(ids)), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            at = 0
            for c, s in _batches(iter(ids), SCORED):
                sums += np.bincount(owner[at:at + len(s)], m.log_probabilities(c, s), len(ids))
                at += len(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sums / np.log(10.0))],
                                             [*[n for n in batch.schema.names if n != "ids"], "symbols"])

    kept = symbols.select("row", "ids", "doc_id", "held_out", "n_tokens", "n_known", "base", "tail")
    return kept.mapInArrow(run, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                                "base double, tail double, symbols double")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortlist: int = 383,
                tails: int = 128, frequent: int = 1 << 17, dim: int = 16, rounds: int = 8) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the model's.
    The model learns from the rows that are not held out.  A null text is empty: its
    one token is the end.  A null id stays null and is a training row; repeated rows
    are texts of their own; very long texts are read in parts and counted whole; if
    nothing is held out, or everything, all rows still have scores; an empty table gives
    an empty result."""
    texts = text_frame(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    counts = written(word_counts(texts, tails), "word-counts")
    ends = texts.where(~F.col("held_out")).count()
    vocab = learn_vocabulary(counts, ends, shortlist=shortlist, tails=tails, frequent=frequent)
    symbols = written(_encoded(texts, vocab, rounds), "symbols")
    model = train(symbols, vocab, dim=dim, rounds=rounds)
    missing = symbols.select("row", F.explode("missing").alias("m")).select("row", "m.word", "m.n")
    rare = missing.join(counts.select("word", "n_train"), "word").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("n_train") + F.lit(1.0))).alias("logs"),
        F.sum(F.when(F.col("n_train") > 0, F.col("n")).otherwise(0)).alias("known"))
    out = _scored(symbols, model).join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    total = F.lit(float(np.log10(vocab.tokens + vocab.distinct + 1.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * total).alias("base_score"),
        (F.col("symbols") + F.col("tail") + logs).alias("score"))
