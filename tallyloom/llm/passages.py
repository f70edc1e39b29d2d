"""Substring dedup: recurring passages are confirmed by their words, compiled into sharded Aho-Corasick
automata over words, and located in every document.

Identical windows of words have the same anchor: the least hash of their short phrases. Anchors are counted
over the corpus, a row for each of a block's anchors, combined before they move. All that has a recurring
anchor is cut into pieces, runs of windows with one anchor, and a piece goes to the shard of its anchor. A
shard compares the windows of its distinct pieces word by word, grows those that recur into passages, compiles
one automaton of all its passages and streams all its pieces through it. What the automaton finds, and nothing
else, is removed. A document's pieces together hold every window of it that could recur, so all documents are
streamed, but each stretch through the one automaton that can know it.

An anchor of more than HOT places would make a hot shard, as each place brings its own surroundings: its pieces
are single windows, sent to the shard of the whole window, where equal ones come as a row a block.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, lean, lean_pair, pack_strings, pieces, read, texts_of, unpack_strings
from tallyloom.llm.dart_minhash import mix

#: Words of a window and of the phrases whose least hash is its anchor; bytes of a block and of a shard's pieces.
WINDOW, PHRASE, BLOCK_BYTES, SHARD_BYTES = 35, 8, 2_000_000, 1_500_000
#: Windows of a piece at most; places of an anchor from which its windows are dealt out one by one.
RUN, HOT = 64, 4_000

def _run(h: np.ndarray, n: int) -> np.ndarray:
    """At each place the hash of n items from there on, by doubling; the last n - 1 mean nothing."""
    out, size = None, 0
    power, width = h, 1
    while True:
        if n & width:
            out, size = (power, width) if out is None else (mix(out + np.uint64(0x9E3779B97F4A7C15) * np.roll(power, -size)), size + width)
        if 2 * width > n:
            return out
        power, width = mix(power + np.uint64(0xC2B2AE3D27D4EB4F) * np.roll(power, -width)), 2 * width


def _extreme(x: np.ndarray, n: int, op, forward: bool) -> np.ndarray:
    """op (np.minimum or np.maximum) over n items from each place on, or up to it."""
    width, sign = 1, -1 if forward else 1
    while 2 * width <= n:
        x, width = op(x, np.roll(x, sign * width)), 2 * width
    return op(x, np.roll(x, sign * (n - width))) if n > width else x


class Block:
    """The words of some texts as numbers, with the anchors of their windows."""

    def __init__(self, texts: list[bytes]) -> None:
        seen = defaultdict(count().__next__)
        # bytes.split() parts at exactly \x20 and \x09-\x0D
        word = [np.fromiter(map(seen.__getitem__, own := x.split()), np.int64, len(own)) for x in texts]
        self.words = list(seen)
        self.counts = np.array([len(w) for w in word], np.int64)
        self.ends = np.cumsum(self.counts)
        self.word = np.concatenate([np.zeros(0, np.int64), *word])
        self.valid = np.arange(len(self.word)) + WINDOW <= np.repeat(self.ends, self.counts)

    def find_anchors(self) -> None:
        """anchor: of each window."""
        self._first = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))[self.word]
        self._phrase = mix(_run(self._first, PHRASE))  # least values; mixed again, they spread evenly
        self.anchor = _extreme(self._phrase, WINDOW - PHRASE + 1, np.minimum, True)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and at how many places each stands."""
        top = _extreme(np.where(self.valid, self.anchor, np.uint64(0)), WINDOW - PHRASE + 1, np.maximum, False)
        return np.unique(self._phrase[top == self._phrase], return_counts=True) if self.valid.any() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def pieces(self, recurring: np.ndarray, hot: np.ndarray) -> list[tuple[int, bool, bytes, bytes]]:
        """(key, hot, starts, words) of the distinct pieces whose anchor recurs, with all their starts here."""
        starts = np.flatnonzero(self.valid)
        if not len(recurring) or not len(starts):
            return []
        order = np.argsort(recurring)
        recurring, hot = recurring[order], hot[order]
        at = np.minimum(np.searchsorted(recurring, self.anchor[starts]), len(recurring) - 1)
        some = recurring[at] == self.anchor[starts]
        starts, at = starts[some], at[some]
        key, single = recurring[at], hot[at]
        if single.any():
            key = np.where(single, _run(mix(self._first), WINDOW)[starts], key)
        fresh = np.append(True, (np.diff(starts) != 1) | (key[1:] != key[:-1]) | single[1:]) if len(starts) else np.zeros(0, bool)
        place = np.arange(len(starts))
        fresh |= (place - np.maximum.accumulate(np.where(fresh, place, 0))) % RUN == 0
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(starts)))
        text = [self.words[i] for i in self.word.tolist()]
        found: dict[tuple, list[int]] = {}
        for k, h, s, e in zip(key[begin].view(np.int64).tolist(), single[begin].tolist(), starts[begin].tolist(), (starts[begin] + size + WINDOW - 1).tolist(), strict=True):
            found.setdefault((k, h, b" ".join(text[s:e])), []).append(s)
        return [(k, h, np.array(at, "<i4").tobytes(), x) for (k, h, x), at in found.items()]


class Shard:
    """Pieces of text, the passages that recur in them, and the automaton that locates these.

    texts: distinct pieces; places: how often each stands in the corpus."""

    def __init__(self, texts: list[bytes], places: np.ndarray) -> None:
        seen = defaultdict(count().__next__)
        word = [np.fromiter(map(seen.__getitem__, own := x.split()), np.int64, len(own)) for x in texts]
        self.sizes = np.array([len(w) + 1 for w in word], np.int64)  # with a word that stands nowhere else between pieces
        gap = np.array([len(seen)], np.int64)
        self.word = np.concatenate([np.zeros(0, np.int64), *(x for w in word for x in (w, gap))])
        self.ends = np.cumsum(self.sizes)
        self.passages = self._confirm(places)

    def _same(self, starts: np.ndarray) -> np.ndarray:
        """Numbers of windows: equal for equal words, and for them alone."""
        _, first, which = np.unique(_run(mix(self.word.astype(np.uint64)), WINDOW)[starts], return_index=True, return_inverse=True)
        other = starts[first][which]
        if all((self.word[starts + k] == self.word[other + k]).all() for k in range(WINDOW)):
            return which
        known: dict[bytes, int] = {}  # two sequences with one hash: tell all apart by their words
        return np.array([known.setdefault(self.word[s : s + WINDOW].tobytes(), len(known)) for s in starts.tolist()], np.int64)

    def _confirm(self, places: np.ndarray) -> list[tuple[int, ...]]:
        """The longest runs of windows that recur, as sequences of words."""
        piece = np.repeat(np.arange(len(self.sizes)), self.sizes)
        starts = np.flatnonzero(np.arange(len(self.word)) + WINDOW < self.ends[piece]) if len(self.word) else np.zeros(0, np.int64)
        if not len(starts):
            return []
        which = self._same(starts)
        starts = starts[np.bincount(which, places[piece[starts]])[which] > 1]
        if not len(starts):
            return []
        begin = np.flatnonzero(np.append(True, np.diff(starts) != 1))
        last = np.append(begin[1:], len(starts)) - 1
        flat = self.word.tolist()
        return list({tuple(flat[s:e]) for s, e in zip(starts[begin].tolist(), (starts[last] + WINDOW).tolist(), strict=True)})

    def locate(self) -> np.ndarray:
        """For each word of the pieces, whether a passage covers it: the automaton's matches over all pieces."""
        covered = np.zeros(len(self.word) + 1, np.int64)
        if self.passages:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
            for p in self.passages:
                automaton.add_word(p)
            automaton.make_automaton()
            found = np.fromiter((x for match in automaton.iter(tuple(self.word.tolist())) for x in match), np.int64).reshape(-1, 2)
            np.add.at(covered, found[:, 0] - found[:, 1] + 1, 1)
            np.add.at(covered, found[:, 0] + 1, -1)
        return np.cumsum(covered)[:-1] > 0

    def ranges(self) -> list[np.ndarray]:
        """Of each piece, the covered ranges (begin, end), counted in its words."""
        edge = np.diff(np.concatenate([[0], self.locate().astype(np.int8), [0]]))  # the words between pieces are never covered
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = self.ends - self.sizes
        own = np.searchsorted(first, begin, side="right") - 1
        both = np.column_stack([begin - first[own], end - first[own]]) if len(begin) else np.zeros((0, 2), np.int64)
        return np.split(both, np.searchsorted(own, np.arange(1, len(first)))) if len(first) else []


def _blocks(batches):
    """Block id, doc_ids and texts (UTF-8)."""
    k, ids, texts, size = 0, [], [], 0
    for batch in pieces(batches, "text", 500_000, 4096):
        ids.append(batch.column("doc_id"))
        texts += [x.encode("utf-8", "surrogatepass") for x in texts_of(batch)]
        size += sum(map(len, texts[-batch.num_rows :]))
        if size >= BLOCK_BYTES:
            yield TaskContext.get().partitionId() << 32 | k, pa.chunked_array(ids), texts
            k, ids, texts, size = k + 1, [], [], 0
    if ids:
        yield TaskContext.get().partitionId() << 32 | k, pa.chunked_array(ids), texts


def _located(rows: list[tuple[int, bytes, bytes]], before: bytes | None) -> pa.RecordBatch:
    """block, ranges of a shard's rows (block, starts, words); before: words that stood in an earlier shard too."""
    known = defaultdict(count().__next__)
    piece = [known[words] for _, _, words in rows]
    places = np.zeros(len(known), np.int64)
    starts = [np.frombuffer(x, "<i4").astype(np.int64) for _, x, _ in rows]
    np.add.at(places, piece, [len(x) for x in starts])
    if before in known:
        places[known[before]] += 1
    ranges = Shard(list(known), places).ranges()
    found = defaultdict(list)
    for (block, _, _), i, at in zip(rows, piece, starts, strict=True):
        if len(ranges[i]):
            found[block].append((at[:, None, None] + ranges[i][None]).reshape(-1, 2))
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([np.concatenate(x).astype("<i4").tobytes() for x in found.values()], pa.binary())], ["block", "ranges"])


def _shards(batches):
    """Rows sorted by key, gathered to shards of about SHARD_BYTES. A key's rows stay together, but for those of
    a single window, which is known to recur from its second place on."""
    rows, size, now, places = [], 0, None, 0
    before = None
    for batch in batches:
        for key, hot, block, starts, words in zip(*(batch.column(c).to_pylist() for c in ("key", "hot", "block", "starts", "words")), strict=True):
            last = rows[-1][2] if rows else before
            if size >= SHARD_BYTES and (key != now or hot and places > 1):
                yield _located(rows, before)
                rows, size, before = [], 0, last if key == now else None
            if key != now or hot and words != last:
                now, places = key, 0
            rows.append((block, starts, words))
            size += len(words) + len(starts)
            places += len(starts) // 4
    if rows:
        yield _located(rows, before)


def remove_recurring(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (string: the words that stay, joined by one space) of every row.

    Words are what stands between \\x20 and \\x09-\\x0D in docs(doc_id, text, ...), unchanged. A word goes if a
    window of WINDOW consecutive words of its document covers it whose words, in order, start anywhere
    else too: in another row or the same, overlaps included. Windows are judged on the input.

    Null and empty texts have no words. Rows that repeat are documents like any other, so all their
    windows recur. Other columns are ignored; an empty table gives an empty result. docs is read once: its
    blocks are written to the checkpoint folder and read from there. Hashes choose what is compared; words
    alone decide. A block holds one text at least, whole, so a worker needs some 40 bytes for each byte
    of the longest text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def store(batches):
        for block, ids, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([pack_strings(texts)], pa.binary())], ["block", "doc_ids", "texts"])

    def anchors(batches):
        for batch in batches:
            for block, texts in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
                own = Block(unpack_strings(texts.as_py()))
                own.find_anchors()
                values, places = own.anchors()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), block)), pa.array(values.view(np.int64)), pa.array(places)], ["block", "anchor", "places"])

    def cut_up(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Block(unpack_strings(left.column("texts")[0].as_py()))
        own.find_anchors()
        rows = own.pieces(right.column("anchor").to_numpy().view(np.uint64), right.column("hot").to_numpy(zero_copy_only=False))
        columns = [pa.array([r[j] for r in rows], t) for j, t in ((0, pa.int64()), (1, pa.bool_()), (2, pa.binary()), (3, pa.binary()))]
        return pa.table([*columns, pa.array([left.column("block")[0].as_py()] * len(rows), pa.int64())], ["key", "hot", "starts", "words", "block"])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Block(unpack_strings(left.column("texts")[0].as_py()))
        edge = np.zeros(len(own.word) + 1, np.int64)
        for x in right.column("ranges").to_pylist():
            begin, end = np.frombuffer(x, "<i4").reshape(-1, 2).T
            np.add.at(edge, begin, 1)
            np.add.at(edge, end, -1)
        gone = np.cumsum(edge)[:-1] > 0
        so_far = np.cumsum(np.append(0, ~gone))
        stay, get = own.word[~gone].tolist(), own.words.__getitem__
        begins, ends = so_far[own.ends - own.counts], so_far[own.ends]
        kept = [b" ".join(map(get, stay[b:e])).decode("utf-8", "surrogatepass") for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
        ids = left.schema.field("doc_ids").type.value_type
        return pa.table({"doc_id": pa.array(left.column("doc_ids")[0].as_py(), ids), "n_words": pa.array(own.counts), "n_removed": pa.array(own.counts - (ends - begins)), "kept": pa.array(kept, pa.string())})

    blocks = cut(docs.select("doc_id", "text").mapInArrow(lean(store), f"block bigint, doc_ids array<{kind}>, texts binary"))
    seen = cut(blocks.select("block", "texts").mapInArrow(lean(anchors), "block bigint, anchor bigint, places bigint"))
    recurring = seen.groupBy("anchor").agg(F.sum("places").alias("places")).where("places > 1").select("anchor", (F.col("places") > HOT).alias("hot"))
    known = seen.join(recurring, "anchor").select("block", "anchor", "hot")
    parts = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lean_pair(cut_up), "key bigint, hot boolean, starts binary, words binary, block bigint")
    found = parts.repartition("key").sortWithinPartitions("key", "words").mapInArrow(lean(_shards), "block bigint, ranges binary")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lean_pair(remove), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the rest of every document."""
    done = remove_recurring(read(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP7 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 x AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
 r AS (SELECT win FROM x GROUP BY win HAVING count(*) > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM x JOIN r USING (win)),
 k AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
 left_ AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM k ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (doc_id)"""
