"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import lean, pieces, read, texts_of

#: Hashed n-grams of 1 to GRAMS characters: 2**HASH_BITS features, of which a text has few.
HASH_BITS, GRAMS = 18, 3
#: Bound of the labelled sample that the weights are fitted on: so many rows in all, shared evenly by the
#: languages, or LEAST_ROWS of each language if that is more. Every language is learnt.
SAMPLE_ROWS, LEAST_ROWS = 2400, 30
#: Characters that are counted at once; weights that are gathered at once.
SLICE, GATHER = 1_000_000, 4_000_000
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return bool(_LETTER.search(text)) and any(c.isalpha() for c in text)


class Sparse(NamedTuple):
    """Rows of features in rising order with their values; row i is from ends[i - 1] to ends[i]."""

    ends: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = np.diff(self.ends, prepend=0)[rows]
        at = np.repeat(self.ends[rows] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        return Sparse(np.cumsum(sizes), self.feature[at], self.value[at])


def _keys(chars: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n, where an n-gram begins and its feature; left: characters from there to the text's end."""
    flat = np.concatenate([chars, np.zeros(GRAMS, np.uint32)])
    key, out = np.zeros(len(chars), np.uint32), []
    for n in range(GRAMS):
        key = (key ^ flat[n : n + len(key)]) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        whole = np.flatnonzero(left > n)
        out.append((whole, key[whole] >> np.uint32(32 - HASH_BITS)))
    return out


def gram_counts(texts: list[str]) -> Sparse:
    """How often each hashed n-gram of each lower-cased text occurs. A long text is counted slice by slice."""
    chars = [np.frombuffer(x.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    parts: list[Sparse] = []
    begin = 0
    while begin < len(chars):
        end, total = begin + 1, len(chars[begin])
        while end < len(chars) and total + len(chars[end]) <= SLICE:
            total, end = total + len(chars[end]), end + 1
        own = chars[begin:end]
        size = np.array([len(x) for x in own])
        if total > SLICE:  # one text
            dense = np.zeros(1 << HASH_BITS, np.int64)
            for at in range(0, total, SLICE):
                some = own[0][at : at + SLICE + GRAMS - 1]
                for where, feature in _keys(some, np.arange(len(some), 0, -1)):
                    dense += np.bincount(feature[where < SLICE], minlength=len(dense))
            feature = np.flatnonzero(dense)
            parts.append(Sparse(np.array([len(feature)]), feature, dense[feature].astype(np.float32)))
        else:
            row = np.repeat(np.arange(len(own)), size)
            spot = np.concatenate([(row[where] << HASH_BITS) | feature for where, feature in _keys(np.concatenate(own), np.repeat(np.cumsum(size), size) - np.arange(total))])
            spot.sort()
            first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1])) if len(spot) else np.zeros(0, np.int64)
            found = spot[first]
            ends = np.cumsum(np.bincount(found >> HASH_BITS, minlength=len(own)))
            parts.append(Sparse(ends, found & ((1 << HASH_BITS) - 1), np.diff(np.append(first, len(spot))).astype(np.float32)))
        begin = end
    before = np.cumsum([0, *(len(p.feature) for p in parts)])
    ends = np.concatenate([np.zeros(0, np.int64), *(p.ends + b for p, b in zip(parts, before, strict=False))])
    return Sparse(ends.astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(p.feature for p in parts)]), np.concatenate([np.zeros(0, np.float32), *(p.value for p in parts)]))


def tf_idf(counts: Sparse, idf: np.ndarray) -> Sparse:
    """log(1 + count) x idf, each row of length 1 (an empty row stays empty)."""
    x = np.log1p(counts.value) * idf[counts.feature]
    row = counts.row_of()
    length = np.sqrt(np.bincount(row, x.astype(float) ** 2, len(counts.ends)))
    return counts._replace(value=(x / np.maximum(length, 1e-12)[row]).astype(np.float32))


def product(x: Sparse, weights: np.ndarray) -> np.ndarray:
    """Rows of x times weights(feature, class)."""
    out = np.zeros((len(x.ends), weights.shape[1]))
    begins = np.append(0, x.ends[:-1])
    step = max(1, GATHER // max(weights.shape[1], 1))
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(x.ends, begins[i] + step, side="right")))
        some = np.flatnonzero(x.ends[i:j] > begins[i:j]) + i
        if len(some):
            own = slice(begins[i], x.ends[j - 1])
            out[some] = np.add.reduceat(weights[x.feature[own]] * x.value[own, None], begins[some] - begins[i], axis=0)
        i = j
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Inverse document frequencies, the rows of weights that are not all 0 (at[feature] or -1), the bias of
    each language and the temperature."""

    langs: tuple[str, ...]
    idf: np.ndarray
    at: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        x = tf_idf(gram_counts(texts), self.idf)
        at = self.at[x.feature]
        used = at >= 0
        ends = np.append(0, np.cumsum(used))[x.ends]
        return (product(Sparse(ends, at[used], x.value[used]), self.weights) + self.bias) / self.temperature

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and calibrated probability; 'und' and 0 for a text without a letter."""
        langs, scores = [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            z = self.logits(part)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for text, best, score in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                known = has_letter(text) and bool(self.langs)
                langs.append(self.langs[best] if known else "und")
                scores.append(float(score) if known else 0.0)
        return langs, scores


def fit_ftrl(x: Sparse, y: np.ndarray, classes: int, features: int, rows: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-5, epochs: int = 12, batch: int = 32) -> np.ndarray:
    """Multinomial weights by follow-the-regularised-leader-proximal with an elastic net: (features + 1 bias, classes).

    rows: those to learn from. l1 and l2 are for each row, as in the mean loss. A step touches the features
    of its rows alone."""
    n = len(rows)
    z, s, rng = np.zeros((features + 1, classes)), np.zeros((features + 1, classes)), np.random.default_rng(7)
    l1, l2 = l1 * n, l2 * n
    target = np.eye(classes)[y]

    def leader(z: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(s)) / alpha + l2))

    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            some = x.take(own)
            used, column = np.unique(some.feature, return_inverse=True)
            part = np.zeros((len(own), len(used) + 1))
            part[some.row_of(), column] = some.value
            part[:, -1] = 1.0
            used = np.append(used, features)
            zu, su = z[used], s[used]
            w = leader(zu, su)
            p = part @ w
            p = np.exp(p - p.max(axis=1, keepdims=True))
            g = part.T @ (p / p.sum(axis=1, keepdims=True) - target[own])
            z[used] = zu + g - (np.sqrt(su + g * g) - np.sqrt(su)) / alpha * w
            s[used] = su + g * g
    return leader(z, s)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least mean log loss on rows that the weights have not seen."""

    def loss(t: float) -> float:
        z = logits / t
        m = z.max(axis=1)
        return float((m + np.log(np.exp(z - m[:, None]).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.02, 10, 120), key=loss) if len(y) else 1.0


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of docs' texts each hashed n-gram occurs, and how many texts there are.

    Every row counts. What reaches the driver is one number for each of the 2**HASH_BITS features."""
    size = 1 << HASH_BITS

    def count(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in pieces(batches, "text", 800_000, 256):
            texts = texts_of(batch)
            total[:size] += np.bincount(gram_counts(texts).feature, minlength=size)
            total[size] += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "n"])

    out = np.zeros(size + 1, np.int64)
    seen = docs.select("text").mapInArrow(lean(count), "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out[seen.column("feature").to_numpy()] = seen.column("n").to_numpy()
    return out[:size], int(out[size])


def fit_language_model(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on labelled(text, lang, key): key is any long that spreads rows evenly, and decides the sample.

    Document frequencies are of all rows, and all values of lang are learnt. The weights are fitted on about
    sample_rows rows (whole texts), evenly many of each language as far as it has them, and LEAST_ROWS of
    each at least. Of this sample each fifth row of a language is left out for the temperature. Rows without text or lang are
    skipped. The driver holds the sample's features and a weight for each of them and each language."""
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang", F.coalesce("key", F.lit(0)).cast("bigint").alias("key"))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = tuple(sorted(counts))
    frequency, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + np.float32(0.1)
    nowhere = np.full(len(idf), -1, np.int32)
    if not langs:
        return LanguageModel((), idf, nowhere, np.zeros((0, 1), np.float32), np.zeros(1, np.float32), 1.0)
    each = max(sample_rows / len(langs), LEAST_ROWS)
    share = labelled.sparkSession.createDataFrame([(x, min(1.0, each / c)) for x, c in counts.items()], "lang string, share double")
    part = F.pmod(F.xxhash64("key", F.lit(8)), F.lit(1_000_003)) / 1_000_003.0
    some = labelled.join(F.broadcast(share), "lang").where(part < F.col("share")).select("text", "lang", "key")

    def features(batches):
        for batch in pieces(batches, "text", 800_000, 256):
            x = tf_idf(gram_counts(texts_of(batch)), idf)
            cut_up = [np.split(v, x.ends[:-1]) for v in (x.feature.astype("<u4"), x.value.astype("<f2"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), *(pa.array([v.tobytes() for v in own], pa.binary()) for own in cut_up)], ["key", "lang", "at", "value"])

    got = some.mapInArrow(lean(features), "key bigint, lang string, at binary, value binary").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("key", "lang", "at", "value")), strict=True))
    del got
    y = np.array([langs.index(r[1]) for r in rows])
    feature = np.frombuffer(b"".join(r[2] for r in rows), "<u4")
    known, column = np.unique(feature, return_inverse=True)
    x = Sparse(np.cumsum([len(r[2]) // 4 for r in rows], dtype=np.int64), column, np.frombuffer(b"".join(r[3] for r in rows), "<f2").astype(np.float32))
    del rows
    by_lang = np.argsort(y, kind="stable")
    nth = np.empty(len(y), np.int64)
    nth[by_lang] = np.arange(len(y)) - np.searchsorted(y[by_lang], y[by_lang])
    apart = nth % 5 == 4
    weights = fit_ftrl(x, y, len(langs), len(known), np.flatnonzero(~apart)).astype(np.float32)
    held = np.flatnonzero(apart)
    temperature = float(fit_temperature(product(x.take(held), weights[:-1]) + weights[-1], y[apart]))
    some = np.flatnonzero(weights[:-1].any(axis=1))
    at = nowhere.copy()
    at[known[some]] = np.arange(len(some))
    return LanguageModel(langs, idf, at, weights[some], weights[-1], temperature)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score; a map over whole texts.

    Null texts and texts without a letter are 'und' with score 0. Every row is judged by itself; columns
    of these two names are replaced, others stay; an empty table gives an empty result. The model is broadcast:
    a number for each feature, and the weights, which grow with the number of languages alone."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, "text", 800_000, 256):
            langs, scores = shared.value.predict(texts_of(batch))
            yield batch.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = fit_language_model(docs.where("not held_out").select("text", "lang", F.col("doc_id").alias("key")))
    return identify(docs.select("doc_id", "text", "held_out"), model).drop("text")
