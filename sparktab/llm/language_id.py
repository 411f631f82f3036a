"""Language identification with hyperdimensional letter profiles.

Every letter owns a fixed random ±1 vector.  A letter trigram is the product of
its letters' vectors, each rotated by its place; a text is the sum (bundle) of
its trigrams; a language is the sum of its training texts.  A text gets the
language whose prototype has the highest cosine with it.

Trigrams lie within words, whose ends count as one more letter.  All sums are
whole numbers, so the prototypes do not depend on partitions or task order."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_frame, written

UNDETERMINED = "und"
#: Texts are encoded in blocks of about so many characters and at most so many texts.
BLOCK_CHARS, BLOCK_TEXTS = 1 << 20, 512
#: A text is encoded in parts of so many characters, so float32 sums stay exact.
PART_CHARS = 1 << 22
#: Up to so many possible trigrams are counted in a table, more are sorted.
TABLE = 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def _letter_vector(code: int, dim: int, seed: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[seed, code])).integers(0, 2, dim, dtype=np.int8)
    return (2 * bits - 1).astype(np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram number) of every trigram; the trigrams as places in
    the alphabet, one row each; the alphabet as code points."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(-1, len(low) + 1), [1, *(len(t) + 1 for t in low), 0])[:len(codes)]
    letter = _letters()[codes]
    keep = letter | np.concatenate([[True], letter[:-1]])  # one word end for a run of other characters
    codes, owner, letter = codes[keep], owner[keep], letter[keep]
    codes = np.where(letter, codes, 0)
    seen = np.bincount(codes)
    seen[0] = 1  # the word end
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[alphabet] = np.arange(len(alphabet))
    sym = place[codes]
    mid = np.flatnonzero(letter)  # the first and last characters are word ends
    k = len(alphabet)
    key = (sym[mid - 1] * k + sym[mid]) * k + sym[mid + 1] if len(mid) else np.zeros(0, np.int64)
    if k ** 3 <= TABLE:
        known = np.flatnonzero(np.bincount(key, minlength=1))
        number = np.zeros(k ** 3, np.int64)
        number[known] = np.arange(len(known))
        which = number[key]
    else:
        known, which = np.unique(key, return_inverse=True)
    return owner[mid], which, np.stack([known // k // k, known // k % k, known % k], 1), alphabet


def bundles(texts: list[str], dim: int, seed: int, rows: np.ndarray | None = None,
            n_rows: int | None = None) -> np.ndarray:
    """The bundle of every text, or of every group of texts if ``rows`` numbers them."""
    n = len(texts) if n_rows is None else n_rows
    owner, which, grams, alphabet = trigrams(texts)
    if rows is not None and len(owner):
        owner = rows[owner]
    if not len(grams):
        return np.zeros((n, dim), np.float32)
    vec = np.stack([_letter_vector(int(c), dim, seed) for c in alphabet])
    gram_vecs = np.roll(vec, 2, 1)[grams[:, 0]]
    gram_vecs *= np.roll(vec, 1, 1)[grams[:, 1]]
    gram_vecs *= vec[grams[:, 2]]
    out = np.empty((n, dim), np.float32)
    step = max(1, (1 << 22) // len(grams))
    order = np.argsort(owner, kind="stable") if rows is not None else slice(None)
    owner, which = owner[order], which[order]
    for a in range(0, n, step):
        b = min(n, a + step)
        lo, hi = np.searchsorted(owner, [a, b])
        counts = np.bincount((owner[lo:hi] - a) * len(grams) + which[lo:hi], minlength=(b - a) * len(grams))
        out[a:b] = counts.reshape(b - a, len(grams)).astype(np.float32) @ gram_vecs
    return out


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = chars = 0
    for b, t in enumerate(texts):
        if b > a and (chars + len(t) > BLOCK_CHARS or b - a >= BLOCK_TEXTS):
            yield a, b
            a, chars = b, 0
        chars += len(t)
    if a < len(texts):
        yield a, len(texts)


def _word_parts(text: str) -> Iterator[str]:
    """Parts of a very long text, cut at a character that is no letter where there is one."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = at + PART_CHARS
        while cut > at + PART_CHARS // 2 and text[cut - 1].isalpha():
            cut -= 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _encoded(texts: list[str], dim: int, seed: int) -> np.ndarray:
    if len(texts) == 1 and len(texts[0]) > PART_CHARS:
        return sum(bundles([p], dim, seed).astype(np.float64) for p in _word_parts(texts[0]))
    return bundles(texts, dim, seed).astype(np.float64)


@dataclass
class Profiles:
    """Prototype vectors of the learned languages, in the order of their names."""
    languages: list[str]
    vectors: np.ndarray
    seed: int

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        dim = self.vectors.shape[1]
        unit = self.vectors / np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)
        langs, scores = [], []
        for a, b in _blocks(texts):
            h = _encoded(texts[a:b], dim, self.seed)
            norm = np.linalg.norm(h, axis=1)
            if not self.languages:
                langs += [UNDETERMINED] * (b - a)
                scores += [0.0] * (b - a)
                continue
            cos = (h @ unit.T) / np.maximum(norm, 1e-12)[:, None]
            best = cos.argmax(1)
            for text, i, c in zip(texts[a:b], best, cos[np.arange(b - a), best], strict=True):
                if any(map(str.isalpha, text)):
                    langs.append(self.languages[i])
                    scores.append(float(min(1.0, max(0.0, c))))
                else:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
        return langs, scores


def held_out(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id's text is divisible by ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def learn_profiles(docs: DataFrame, train: Column, *, text_col: str = "text", lang_col: str = "lang",
                   dim: int = 1024, seed: int = 42, max_languages: int = 1024) -> Profiles:
    """Prototypes from every row where ``train`` holds and text and language are not null.

    A task adds its rows up and emits one vector per language; those are summed
    by (language, dimension) with partial aggregation.  The result has at most
    ``max_languages`` × ``dim`` numbers; more languages are an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                names = sorted(set(langs[a:b]))
                if b - a == 1:
                    got = _encoded(texts[a:b], dim, seed)
                else:
                    rows = np.array([names.index(x) for x in langs[a:b]])
                    got = bundles(texts[a:b], dim, seed, rows, len(names))
                for name, v in zip(names, got, strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.int64)
                if len(sums) > max_languages:
                    raise ValueError(f"more than {max_languages} languages in the training rows")
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()),
                                              pa.array([v], pa.list_(pa.int64()))], ["lang", "v"])

    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    parts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "lang string, v array<bigint>")
    sums = written(parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i")
                   .agg(F.sum("x").alias("x")), "prototypes")
    if (n := sums.select("lang").distinct().limit(max_languages + 1).count()) > max_languages:
        raise ValueError(f"more than {max_languages} languages in the training rows")
    table = sums.orderBy("lang", "i").toPandas()
    languages = sorted(table["lang"].unique())
    return Profiles(languages, table["x"].to_numpy(np.float64).reshape(n, dim), seed)


def predict_languages(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row.

    Null, empty and letterless texts are ``und`` with score 0, as is every text if
    nothing was learned; ties go to the first language by name; a null id stays
    null and is not held out; repeated rows are predicted one by one; very long
    texts are read whole; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = sent.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    texts = text_frame(docs, id_col, text_col)
    return texts.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("h"),
                        "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def known_language_only(docs: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, columns unchanged.

    Rejected is what ``predict_languages`` calls ``und``: null and letterless texts,
    and all if nothing was learned."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            langs, _ = sent.value.predict([t or "" for t in texts])
            yield batch.filter(pa.array([x != UNDETERMINED for x in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
