"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import lean, pieces, read, texts_of

#: Bounds of the labelled sample: rows of label 1 and of label 0.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 4_500
#: Of the sample, rows that scores are calibrated on.
CALIBRATION_ROWS = 3_000
NEIGHBOURS, THRESHOLD, BLOCK = 15, 0.3, 32
#: Deviations that a term has to differ between the labels before it weighs more than its idf.
NOISE = 3.0
#: Terms in one of so many rows or more are kept as dense rows; texts that are searched for at once.
COMMON, TOGETHER = 16, 32
#: More than single precision loses in a sum of products of unit vectors.
ERROR = 1e-4

_words = re.compile(r"\w+").findall


def terms_of(text: str) -> list[str]:
    return _words(text.lower())


def hashed_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct terms as sorted hashes of 64 bits, and how often each occurs."""
    counts = Counter(terms_of(text))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in counts), np.uint64, len(counts))
    order = np.argsort(h)
    return h[order], np.fromiter(counts.values(), np.int32, len(counts))[order]


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of slices, one slice after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class BlockMaxIndex:
    """Postings of unit vectors by term; rows are in blocks.

    A common term (one of COMMON rows has it) is a dense row of weights with the largest weight of each
    block. Postings of the others are added up as they are."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> None:
        row, term = np.nonzero(vectors)
        self._load(row, term, vectors[row, term], vectors.shape[1], ids, block)

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, ids: np.ndarray, block: int = BLOCK) -> BlockMaxIndex:
        """From the non-zero components."""
        own = cls.__new__(cls)
        own._load(row, term, weight, terms, ids, block)
        return own

    def _load(self, row, term, weight, terms, ids, block) -> None:
        n = len(ids)
        top = np.zeros(n, np.int64)
        by_weight = np.argsort(weight, kind="stable")
        top[row[by_weight]] = term[by_weight]  # each row's heaviest term: like beside like
        self.order = np.lexsort((ids, top))
        self.ids, self.block, self.blocks = ids[self.order], block, -(-n // block)
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        rows = np.bincount(term, minlength=terms)
        common = np.flatnonzero(rows * COMMON >= max(n, 1))
        self.slot = np.full(terms, -1, np.int32)
        self.slot[common] = np.arange(len(common))
        dense = self.slot[term] >= 0
        self.dense = np.zeros((len(common), self.blocks * block))
        self.dense[self.slot[term[dense]], place[row[dense]]] = weight[dense]
        self.rough = self.dense.astype(np.float32)  # what is added up first; answers are made of dense
        self.most = self.dense.reshape(len(common), self.blocks, block).max(axis=2) if n else np.zeros((len(common), 0))
        rest = np.flatnonzero(~dense)
        rest = rest[np.argsort(term[rest], kind="stable")]
        self.rows, self.weights = place[row[rest]], weight[rest].astype(np.float64)
        self.starts = np.append(0, np.cumsum(np.where(self.slot >= 0, 0, rows))).astype(np.int32)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> list[tuple[float, int, int]]:
        """The k best (similarity, id, row as given), best first, ties to smaller ids; all if fewer match."""
        return self.search_all([(terms, weights)], k, [without])[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int | None] | None = None) -> list[list[tuple[float, int, int]]]:
        """The same for each of some queries.

        Rare terms are added up first. The k-th best of these sums is a bound that the answers reach; blocks
        whose best sum and largest common weights can't reach it for any of the queries are passed over. In
        the others common terms are added up in single precision; whoever comes within its error of the k-th
        best gets the exact sum."""
        width = self.blocks * self.block
        if not queries or not width:
            return [[] for _ in queries]
        of = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        term, weight = np.concatenate([t for t, _ in queries]).astype(np.int64), np.concatenate([w for _, w in queries])
        sizes = self.starts[term + 1] - self.starts[term]
        at = _slices(self.starts[term], sizes)
        score = np.bincount(np.repeat(of * width, sizes) + self.rows[at], np.repeat(weight, sizes) * self.weights[at], len(queries) * width).reshape(len(queries), width).astype(float)  # without postings it is of integers
        gone = [None if x is None else np.flatnonzero(self.order == x) for x in without or [None] * len(queries)]
        for own, x in zip(score, gone, strict=True):
            if x is not None:
                own[x] = -2.0
        common = self.slot[term] >= 0
        asked = np.zeros((len(queries), len(self.dense)))
        asked[of[common], self.slot[term[common]]] = weight[common]
        least = np.partition(score, width - k, axis=1)[:, width - k] if width > k else np.zeros(len(queries))
        reach = score.reshape(len(queries), self.blocks, self.block).max(axis=2) + asked @ self.most
        alive = (reach >= np.maximum(least, 0.0)[:, None] - 1e-9).any(axis=0)
        cells = slice(None) if alive.mean() > 0.6 else np.flatnonzero(np.repeat(alive, self.block))
        rough = score.astype(np.float32)
        rough[:, cells] += asked.astype(np.float32) @ self.rough[:, cells]
        out = []
        for own, about, common in zip(score, rough, asked, strict=True):
            near = np.flatnonzero(about >= max(np.partition(about, width - k)[width - k] if width > k else 0.0, 0.0) - ERROR)
            some = np.flatnonzero(common)
            own = own[near] + common[some] @ self.dense[some[:, None], near]
            near, own = near[own > 0], own[own > 0]
            best = np.round(own, 9)
            order = np.lexsort((self.ids[near], -best))[:k]
            near = near[order]
            out.append(list(zip(best[order].tolist(), self.ids[near].tolist(), self.order[near].tolist(), strict=True)))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing function of x nearest to y (pool adjacent violators)."""
    xs, at = np.unique(x, return_inverse=True)
    w = np.bincount(at, weight)
    pools: list[list[float]] = []
    for left, value, mass in zip(xs, np.bincount(at, weight * y) / np.maximum(w, 1e-12), w, strict=True):
        pools.append([left, left, value, mass])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            low, high = pools[-2], pools.pop()
            low[1], low[2], low[3] = high[1], (low[2] * low[3] + high[2] * high[3]) / (low[3] + high[3]), low[3] + high[3]
    return np.array([p for pool in pools for p in pool[:2]]), np.array([pool[2] for pool in pools for _ in range(2)])


@dataclass
class ToxicityModel:
    """Terms (sorted hashes) with their weights, the index of labelled rows, and what makes scores of votes."""

    terms: np.ndarray
    factor: np.ndarray  # idf, times more for what tells the labels apart
    index: BlockMaxIndex
    labels: np.ndarray
    row_weight: np.ndarray
    nothing: float  # score of a text without any of the terms
    points: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    known: dict | None = None  # answers of this process, by vector

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's known terms and their weights, (1 + log tf) x factor, of length 1."""
        h, counts = hashed_terms(text)
        at, there = known_among(self.terms, h)
        w = (1 + np.log(counts[there])) * self.factor[at]
        return at, w / np.linalg.norm(w) if len(at) else w

    def vote(self, found: list[tuple[float, int, int]]) -> float:
        """Share of label 1 among the neighbours, weighted by 1 / (distance + 0.05)."""
        rows = [r for _, _, r in found]
        w = self.row_weight[rows] / (1.05 - np.array([s for s, _, _ in found]))
        return float((w * self.labels[rows]).sum() / w.sum())

    def judge(self, texts: list[str]) -> list[tuple[float, list[tuple[float, int, int]]]]:
        """Calibrated score of each text and the neighbours that it rests on."""
        if self.known is None or len(self.known) > 2_000:
            self.known = {}
        out = []
        for begin in range(0, len(texts), TOGETHER):
            vectors = [self.vector(x) for x in texts[begin : begin + TOGETHER]]
            keys = [xxhash.xxh3_128_digest(at.tobytes() + w.tobytes()) for at, w in vectors]
            new = {key: v for key, v in zip(keys, vectors, strict=True) if key not in self.known}
            for key, found in zip(new, self.index.search_all(list(new.values()), NEIGHBOURS), strict=True):
                vote = self.vote(found) if found else 0.0
                self.known[key] = (float(np.clip(0.999 * np.interp(vote, *self.points) + 0.001 * vote, 0.0, 1.0)) if found else self.nothing, found)
            out += [self.known[key] for key in keys]
        return out


def known_among(terms: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the hashes h are among the sorted terms, of those that are, and which of h these are."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    there = terms[at] == h
    return at[there], there


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> ToxicityModel:
    """Fit on docs(doc_id, text) and labels(doc_id, toxic); rows with a null id or label are skipped.

    At most about toxic_rows and clean_rows labelled rows are sampled, by a hash of the id; weights make
    up for their unequal shares. All their terms count and all their rows are in the index. A term weighs
    its idf, over all rows of docs, times 1 + what the root of its chi-square (with Yates' correction, for
    either label) has above NOISE. Labels of one doc_id that disagree count as 1. Terms are told apart by
    hashes of 64 bits. The sample alone reaches the driver, as hashes and counts.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = {r.toxic: r["count"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    most = {1: toxic_rows, 0: clean_rows}
    share = F.when(F.col("toxic") == 1, toxic_rows / max(total.get(1, 0), 1)).otherwise(clean_rows / max(total.get(0, 0), 1))
    picked = labels.where("toxic in (0, 1)").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_003)) / 1_000_003.0 < share)
    # a sample of bounded size; the text side never moves
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def count_terms(batches):
        for batch in pieces(batches, "text"):
            got = [hashed_terms(x) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array([x[j].tobytes() for x in got], pa.binary()) for j in (0, 1))], ["doc_id", "toxic", "terms", "counts"])

    got = sample.mapInArrow(lean(count_terms), "doc_id bigint, toxic int, terms binary, counts binary").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "toxic", "terms", "counts")), strict=True))
    del got
    sizes = Counter(r[1] for r in rows)
    weight = {k: total.get(k, 0) / max(sizes[k], 1) if total.get(k, 0) > most[k] else 1.0 for k in (0, 1)}
    base = [(weight[r[1]], r[1]) for r in rows if not r[2]]
    # as if one more text of the common rate had been seen
    rate = sum(weight[r[1]] * r[1] for r in rows) / max(sum(weight[r[1]] for r in rows), 1e-9)
    nothing = (sum(w * y for w, y in base) + rate) / (sum(w for w, _ in base) + 1)
    rows = [r for r in rows if r[2]]
    label = np.array([r[1] for r in rows], np.int64)
    ids = np.array([r[0] for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) // 8 for r in rows])
    terms, term = np.unique(np.frombuffer(b"".join(r[2] for r in rows), np.uint64), return_inverse=True)
    term = term.astype(np.int32)
    tf = 1 + np.log(np.frombuffer(b"".join(r[3] for r in rows), np.int32))
    del rows

    def frequencies(batches):
        known = shared.value
        df, n = np.zeros(len(known) + 1, np.int64), 0
        for batch in pieces(batches, "text"):
            got = [hashed_terms(text)[0] for text in texts_of(batch)]
            df += np.bincount(known_among(known, np.concatenate(got))[0], minlength=len(df))
            n += batch.num_rows
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])

    shared = docs.sparkSession.sparkContext.broadcast(terms)
    seen = docs.select("text").mapInArrow(lean(frequencies), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(terms) + 1)
    df[seen.column("term").to_numpy()] = seen.column("df").to_numpy()
    n1, n0 = sizes[1], sizes[0]
    a = np.bincount(term[label[row] == 1], minlength=len(terms)).astype(float)
    b = np.bincount(term, minlength=len(terms)) - a
    off = np.maximum(np.abs(a * (n0 - b) - b * (n1 - a)) - (n1 + n0) / 2, 0.0)
    root = off * np.sqrt((n1 + n0) / (float(max(n1, 1)) * max(n0, 1) * np.maximum(a + b, 1) * np.maximum(n1 + n0 - a - b, 1)))
    factor = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1) * (1 + np.maximum(root - NOISE, 0.0))
    w = tf * factor[term]
    w /= np.sqrt(np.bincount(row, w * w, len(ids)))[row]
    model = ToxicityModel(terms, factor, BlockMaxIndex.of(row, term, w, len(terms), ids), label.astype(float), np.array([weight[y] for y in label.tolist()]), nothing)
    if len(ids):  # votes of labelled rows' other neighbours against their labels
        some = np.random.default_rng(13).permutation(len(ids))[:CALIBRATION_ROWS]
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(ids))))
        votes = []
        for begin in range(0, len(some), TOGETHER):
            part = some[begin : begin + TOGETHER].tolist()
            found = model.index.search_all([(term[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]) for i in part], NEIGHBOURS, part)
            votes += [model.vote(x) if x else nothing for x in found]
        model.points = isotonic(np.array(votes), model.labels[some], model.row_weight[some])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score, predicted (1 from THRESHOLD on) and neighbours (doc_id, similarity, toxic).

    A map over whole texts; equal texts get equal scores. Null and empty texts have no terms and get the
    rate of such texts. Rows are judged by text alone; columns of these three names are replaced, others
    stay; an empty table gives an empty result. The model's size is bounded by the sample.
    """
    docs = docs.drop("score", "predicted", "neighbours")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        own = shared.value
        own.known = None
        for batch in pieces(batches, "text", 1_000_000, 512):
            got = own.judge(texts_of(batch))
            evidence = [[{"doc_id": i, "similarity": s, "toxic": int(own.labels[r])} for s, i, r in found] for _, found in got]
            scores = [s for s, _ in got]
            yield batch.append_column("score", pa.array(scores, pa.float64())).append_column("predicted", pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())).append_column("neighbours", pa.array(evidence, near))
        own.known = None

    out = T.StructType([*docs.schema.fields, *T._parse_datatype_string("score double, predicted int, neighbours array<struct<doc_id:bigint,similarity:double,toxic:int>>").fields])
    return docs.mapInArrow(lean(run), out)


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs without the rows that are predicted toxic; all columns stay, whatever their names."""
    return score_toxicity(docs.select(F.struct("*").alias("row"), "text"), model).where("predicted = 0").select("row.*")


def learnable(labels: DataFrame) -> DataFrame:
    """Labels of rows that are not held out."""
    return labels.where("crc32(cast(doc_id as string)) % 4 <> 2").select("doc_id", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = fit_toxicity(docs, learnable(read(spark, sf_dir, "labels", "doc_id", "toxic")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "neighbours")
