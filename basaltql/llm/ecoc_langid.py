"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit (logistic, on hashed byte 2- and 3-grams of the
lower-cased text) predicts it.  Up to seven languages use the exhaustive code, more a fixed random one of
10 * log2(n) bits.  Decoding sums each bit's logistic loss, weighted by how well the bit was learned, and takes the
nearest codeword; a small margin between the two nearest flags the row as ambiguous.

Fitting uses a bounded sample: about PER_LANG labelled texts per language, picked by a hash of doc_id.  Every language
that a labelled row names has a codeword, however rare; the sample is held as sparse rows.  Every text is scored whole.  Null texts and texts without a letter are `und`
with score 0; so is every text if no language could be learned.  Ties go to the first language by name.  A null
doc_id is kept.  Repeated rows yield repeated rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, PER_LANG, STEPS, AMBIGUOUS, CHUNK, ROWS = 1 << 13, 400, 150, 0.15, 1 << 20, 4096
LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean"
#: Digits, controls and ASCII punctuation count as white space.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _features(texts: list[str]) -> np.ndarray:
    """One row of length 1 per text: square roots of its hashed n-gram counts."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer((" " + t.lower() + " ").encode().translate(PLAIN), np.uint8)
        total = np.zeros(DIM, np.int64)
        for lo in range(0, len(raw), CHUNK):
            b = raw[lo : lo + CHUNK + 2].astype(np.uint32)
            two = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(40503)
            three = two[:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)
            for h in (two[:CHUNK], three[:CHUNK]):
                total += np.bincount((h ^ h >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(19), minlength=DIM)
        out[i] = np.sqrt(total)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _packed(row: np.ndarray) -> bytes:
    """A row's places and values in 16 bits each."""
    value = (row * 65535).astype("<u2")
    place = np.flatnonzero(value)
    return place.astype("<u2").tobytes() + value[place].tobytes()


def has_letter(text: str) -> bool:
    """Whether a character of a letter category is in a text, as `\\p{L}` tells; numbers such as ½ are none."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


class Sparse:
    """Rows of features as (places, values), made dense ROWS at a time."""

    def __init__(self, rows: list[bytes]):
        both = [np.frombuffer(r, "<u2").reshape(2, -1) for r in rows]
        self.at = np.cumsum([0, *(b.shape[1] for b in both)])
        self.place, self.value = (np.concatenate([b[k] for b in both]) if both else np.zeros(0, "<u2") for k in (0, 1))

    def __len__(self):
        return len(self.at) - 1

    def parts(self):
        """(rows, their features at length 1) of all rows."""
        for lo in range(0, len(self), ROWS):
            hi = min(lo + ROWS, len(self))
            x, cut = np.zeros((hi - lo, DIM), np.float32), slice(self.at[lo], self.at[hi])
            x[np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1])), self.place[cut]] = self.value[cut]
            yield slice(lo, hi), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """Rows of -1 and 1, one per language, no two alike."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 7:
        return np.array([[1 if (col >> (n - 1 - row)) & 1 else -1 for col in range(1 << (n - 1), (1 << n) - 1)] for row in range(n)], float)
    rnd, bits = np.random.RandomState(7), int(10 * np.log2(n)) + 1
    code = rnd.choice([-1.0, 1.0], (n, bits))
    while len(np.unique(code, axis=0)) < n:
        code = rnd.choice([-1.0, 1.0], (n, bits))
    return code


class Model:
    def __init__(self, langs: list[str], x: Sparse, y: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        bits = self.code.shape[1]
        self.w, self.b, self.trust = np.zeros((DIM, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32)
        if bits and len(x):
            want = self.code[y].astype(np.float32)
            share = np.bincount(y, minlength=len(langs))[y].astype(np.float32)
            weight = (len(y) / len(langs) / share)[:, None]
            kept = list(x.parts()) if len(x) <= 4 * ROWS else None  # a small sample stays dense
            for _ in range(STEPS):
                gw, gb = np.zeros_like(self.w), np.zeros_like(self.b)
                for own, part in kept or x.parts():
                    m = part @ self.w + self.b
                    g = weight[own] * want[own] / (1 + np.exp(np.clip(want[own] * m, -30, 30)))
                    gw += part.T @ g
                    gb += g.sum(0)
                self.w += 20.0 * (gw / len(x) - 1e-4 * self.w)
                self.b += 2.0 * gb / len(x)
            hit = sum((weight[own] * ((part @ self.w + self.b) * want[own] > 0)).sum(0) for own, part in kept or x.parts()) / len(x)
            self.trust = np.log(np.clip(hit, 0.5001, 0.9999) / (1 - np.clip(hit, 0.5001, 0.9999))).astype(np.float32)
            self.trust /= self.trust.sum()

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        if not self.langs:
            return [("und", 0.0, False)] * len(texts)
        out = []
        for lo in range(0, len(texts), 64):
            margin = _features(texts[lo : lo + 64]) @ self.w + self.b
            loss = (np.logaddexp(0, -margin) * self.trust) @ (self.code > 0).T + (np.logaddexp(0, margin) * self.trust) @ (self.code < 0).T
            p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            top = np.sort(p, axis=1)
            out += [(self.langs[k], float(p[i, k]), len(self.langs) > 1 and bool(top[i, -1] - top[i, -2] < AMBIGUOUS)) for i, k in enumerate(best)]
        return [r if has_letter(t) else ("und", 0.0, False) for r, t in zip(out, texts, strict=True)]


def fit(documents: DataFrame, training: Column) -> Model:
    """Learns from a bounded sample of the rows where `training` holds and lang is known."""
    known = documents.where(training & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = sorted((r["count"], r.lang) for r in known.groupBy("lang").count().collect())
    langs = sorted(lang for _, lang in counts)
    if not langs:
        return Model([], Sparse([]), np.zeros(0, int))
    share = documents.sparkSession.createDataFrame([(lang, PER_LANG / n) for n, lang in counts], "lang string, _share double")
    picked = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_share") * (1 << 30))

    def each(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                x = _features(b.column(1)[lo : lo + 64].to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + 64], pa.array([_packed(r) for r in x], pa.binary())], ["lang", "x"])

    rows = picked.select("lang", "text").mapInArrow(each, "lang string, x binary").collect()
    number = {lang: k for k, lang in enumerate(langs)}
    return Model(langs, Sparse([r.x for r in rows]), np.array([number[r.lang] for r in rows], int))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""

    def each(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = model.predict([t or "" for t in part.column(1).to_pylist()])
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, SCHEMA)
