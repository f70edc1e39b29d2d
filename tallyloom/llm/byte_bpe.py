"""Byte-level BPE: each distinct pre-token is encoded once for the whole corpus, then joined back.

The data move in blocks, not in rows of one word: a block is a few million bytes of documents. It explodes
its texts into pre-tokens with positions, keeps them as indices into its own distinct words, and sends each
distinct word to the bucket of its hash. A bucket encodes every distinct word once and answers each block; the
block puts the ids back by position. A frequent word is one entry of each block, so there is no hot key.
Decoding knows nothing of words: it joins every id with the table of the tokens' bytes.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import lean, lean_pair, pack_strings, pieces, read, remembers, texts_of, unpack_strings

#: Bytes of text in a block; of corpus for each bucket of distinct words; the fewest and the most buckets.
BLOCK_BYTES, BUCKET_BYTES, BUCKETS = 6_000_000, 16_000_000, (128, 1 << 16)
#: Words that a bucket remembers at once; beyond, which takes more than 10^11 distinct ones, some are encoded anew.
REMEMBERED = 2_000_000


_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xff]")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+").findall


class Ranks:
    """A rank file of the tiktoken library with the pattern that splits texts before it applies."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._split = regex.compile(public_tokenizers.PATTERN).findall
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.wire = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")  # of ids on their way
        # the token-byte table: bytes of all tokens in the order of their ids, where each begins and its length
        order = sorted(ranks, key=ranks.__getitem__)
        self._bytes = np.frombuffer(b"".join(order), np.uint8)
        self._length = np.zeros(max(ranks.values()) + 1, np.int64)
        self._length[[ranks[x] for x in order]] = [len(x) for x in order]
        self._begin = np.cumsum(self._length) - self._length

    def split(self, text: str) -> list[str]:
        """Pre-tokens. In Latin-1 without the spaces on which libraries differ, re does it faster."""
        return self._split(text) if _OTHER.search(text) else _LATIN(text)

    def encode(self, word: bytes) -> bytes:
        """The word's ids as they travel."""
        return np.array(self.encoding._encode_single_piece(word), self.wire).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, by a join with the token-byte table; an id that it doesn't have is an error."""
        out = []
        for at in range(0, len(ids), 200_000):
            some = ids[at : at + 200_000]
            if len(some) and (some.max() >= len(self._length) or not self._length[some].all()):
                raise ValueError("an id without bytes")
            size = self._length[some]
            place = np.repeat(self._begin[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out.append(self._bytes[place].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    """One for each Python worker; the file belongs to an installed package and has a fixed size."""
    return Ranks(path)


remembers(__name__, ranks_of.cache_clear)


def _blocks(batches, path: str, buckets: int):
    """block id, doc_ids, distinct words by first use, bucket of each, and of each text the indices of its words."""
    split = ranks_of(path).split

    def blocks():
        ids, seen, index, size = [], defaultdict(count().__next__), [], 0
        for batch in pieces(batches, "text", 1_000_000, 4096):
            ids.append(batch.column("doc_id"))
            for text in texts_of(batch):
                index.append(np.fromiter(map(seen.__getitem__, own := split(text)), np.uint32, len(own)))
                size += len(text)
            if size >= BLOCK_BYTES:
                yield ids, seen, index
                ids, seen, index, size = [], defaultdict(count().__next__), [], 0
        if ids:
            yield ids, seen, index

    for k, (ids, seen, index) in enumerate(blocks()):
        words = [w.encode("utf-8", "surrogatepass") for w in seen]
        hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        yield TaskContext.get().partitionId() << 32 | k, pa.chunked_array(ids), words, hashes, index


def _planes(index: list[np.ndarray]) -> bytes:
    """Lengths, then the low bytes of all indices, the next ones and so on, compressed: common words,
    met early, have small indices."""
    flat = np.concatenate(index) if index else np.zeros(0, np.uint32)
    lengths = np.array([len(x) for x in index], "<u4")
    planes = np.ascontiguousarray(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(index)) + lengths.tobytes() + planes.tobytes())


def _from_planes(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    (n,) = struct.unpack_from("<I", data)
    lengths = np.frombuffer(data, "<u4", n, 4)
    planes = np.frombuffer(data, np.uint8, offset=4 + 4 * n).reshape(4, -1)
    return np.split(np.ascontiguousarray(planes.T).view("<u4").ravel(), np.cumsum(lengths)[:-1]) if n else []


def encode_corpus(docs: DataFrame, ranks: str, buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) of every row.

    ids are what tiktoken's encode_ordinary gives for docs' text with the rank file at ranks. The number of
    buckets follows the bytes of text, if it isn't given. Null and empty texts have no ids. Rows that repeat,
    or have no doc_id, are encoded each by itself; other columns are ignored; an empty table gives an
    empty result. docs is read twice and must give the same rows in the same partitions, as tables do;
    if it did not, the run would end with an error, not with wrong ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    if buckets is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(BUCKETS[1], max(BUCKETS[0], total // BUCKET_BYTES))

    def words(batches):
        for block, _, own, hashes, _ in _blocks(batches, ranks, buckets):
            bucket = hashes % buckets
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(own) else np.zeros(0, np.int64)
            sent = [pack_strings([own[i] for i in part]) for part in np.split(order, starts[1:])] if len(own) else []
            n = len(starts)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block] * n, pa.int64()), "check": pa.array([zlib.crc32(hashes)] * n, pa.int64()), "bucket": pa.array(bucket[order[starts]].astype(np.int32)), "words": pa.array(sent, pa.binary())})

    def answer(batches):
        encode, known, now = ranks_of(ranks).encode, {}, -1
        for batch in batches:
            out = []
            for bucket, own in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != now:
                    known, now = {}, bucket  # rows come sorted: each distinct word is met in one bucket
                ids = []
                for w in unpack_strings(own):
                    if w not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = encode(w)
                    ids.append(known[w])
                out.append(pack_strings(ids))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("check"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "check", "bucket", "ids"])

    def positions(batches):
        for block, ids, _, hashes, index in _blocks(batches, ranks, buckets):
            own = pa.array([ids.to_pylist()], pa.list_(ids.type))
            where = zstandard.ZstdCompressor(level=1).compress((hashes % buckets).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zlib.crc32(hashes)], pa.int64()), own, pa.array([where], pa.binary()), pa.array([_planes(index)], pa.binary())], ["block", "check", "doc_ids", "buckets", "index"])

    def rebuild(left: pa.Table, right: pa.Table) -> pa.Table:
        own = ranks_of(ranks)
        kept = left.to_pylist()[0] if left.num_rows == 1 else {"check": None}
        if right.num_rows and set(right.column("check").to_pylist()) != {kept["check"]}:
            raise RuntimeError("documents were read in other blocks the second time; give a table or a checkpoint")
        order = np.argsort(right.column("bucket").to_numpy())
        answers = right.column("ids").to_pylist()
        sent = [x for i in order for x in unpack_strings(answers[i])]
        place = np.empty(len(sent), np.int64)
        place[np.argsort(np.frombuffer(zstandard.decompress(kept["buckets"]), "<u2"), kind="stable")] = np.arange(len(sent))
        ids = [sent[i] for i in place.tolist()]
        n, out = [], []
        for x in _from_planes(kept["index"]):
            out.append(np.frombuffer(b"".join(map(ids.__getitem__, x.tolist())), own.wire).astype("<u4").tobytes())
            n.append(len(out[-1]) // 4)
        return pa.table({"doc_id": pa.array(kept["doc_ids"], left.schema.field("doc_ids").type.value_type), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(out, pa.binary())})

    asked = docs.mapInArrow(lean(words), "block bigint, check bigint, bucket int, words binary")
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(answer), "block bigint, check bigint, bucket int, ids binary")
    placed = docs.mapInArrow(lean(positions), f"block bigint, check bigint, doc_ids array<{kind}>, buckets binary, index binary")
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean_pair(rebuild), f"doc_id {kind}, n_tokens bigint, ids binary")


def decode_corpus(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded(ids, ...) with decoded, the bytes of each row's ids (binary as encode_corpus gives them).

    Every id of every row is joined with the token-byte table of the rank file, which has a fixed size and is
    with each worker, so nothing is shuffled. Null ids give null, no ids no bytes; an id that the table
    doesn't have ends the query. A column decoded is replaced, others stay; an empty table gives an empty result."""
    encoded = encoded.drop("decoded")

    def run(batches):
        own = ranks_of(ranks)
        for batch in pieces(batches, "ids", 4_000_000, 4096):
            yield batch.append_column("decoded", pa.array([None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()], pa.binary()))

    return encoded.mapInArrow(lean(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = decode_corpus(encode_corpus(read(spark, sf_dir, "documents", "doc_id", "text"), ranks), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
