"""Packing by power-of-two decomposition: every sequence is one piece of one document."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import lean, pieces, read, remembers, texts_of

#: Texts of these characters alone are split into words here; for any other, the library splits them.
#: In this range all Unicode versions agree on letters, digits, space and case. "<|" may begin a special token.
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xff]|<\\|")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\s0-9a-z²³¹¼½¾ªµºß-öø-ÿ]+")
#: Words whose ids a worker remembers.
_REMEMBERED = 400_000


def _splittable(text: str) -> bool:
    if text.isascii():
        return not ("<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return not _OTHER.search(text)


class WordEncoder:
    """A tokenizer file of the tokenizers library, asked once for each word that comes up again.

    Words are encoded apart from each other by this model, so ids of words, joined, are ids of texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_words(self, words: list[str]) -> list[bytes]:
        """As _ask, but in one call: the vocabulary marks each token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids if words else [], "<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
        if len(ends) != len(words) or len(words) and ends[-1] != ids.nbytes:
            return self._ask(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if words else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        words = [_WORDS.findall(x.lower()) if _splittable(x) else None for x in texts]
        used = set(chain.from_iterable(filter(None, words)))
        if len(self.known) > _REMEMBERED:  # words that come up again are kept
            self.known = {w: self.known[w] for w in used.intersection(self.known)}
        new = list(used.difference(self.known))
        for at in range(0, len(new), 50_000):
            self.known.update(zip(new[at : at + 50_000], self._ask_words(new[at : at + 50_000]), strict=True))
        rest = iter(self._ask([x for x, own in zip(texts, words, strict=True) if own is None]))
        known, get = self.known, self.known.__getitem__
        return [next(rest) if own is None else b"".join(itemgetter(*own)(known) if len(own) > 1 else map(get, own)) for own in words]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker. The file is part of an installed package, the same on every machine."""
    return WordEncoder(path)


remembers(__name__, encoder.cache_clear)


def binary_lengths(total: int, most: int) -> list[int]:
    """Powers of two that add up to total, largest first, none above most (itself a power of two)."""
    rest = total % most
    return [most] * (total // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack_binary(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 1) -> DataFrame:
    """Cut the token ids of every row of docs(doc_id, text, ...) into pieces of power-of-two length.

    Each piece is a sequence by itself: nothing crosses documents and nothing is padded, as sequences
    of one bucket (bucket: log2 of the length) have equal lengths. Ids are those of the tokenizer file,
    then end_id. Returns doc_id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens,
    bucket, sequence_id, offset. A map over whole texts; sequence_id numbers the pieces, with gaps.

    Null and empty texts give one piece with end_id alone. Rows that repeat, or have no doc_id, are
    packed each by itself. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        own = encoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches, "text", 2_000_000, 1024):
            row, start, length, ids, tokens = [], [], [], [], []
            for i, got in enumerate(own.encode(texts_of(batch))):
                got += tail
                at = 0
                for n in binary_lengths(len(got) // 4, most):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    ids.append(got[4 * at : 4 * (at + n)])
                    tokens.append(len(got) // 4)
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"])

    made = docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint")
    return made.withColumns({"bucket": F.round(F.log2("length")).cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """pack_binary's pieces as a table with a folder for each bucket, so that equal lengths lie together and a
    reader of one length opens one folder. A task writes a file for each bucket that it has; nothing moves."""
    packed.write.partitionBy("bucket").parquet(path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, at most 2,048 ids a sequence."""
    import public_tokenizers

    packed = pack_binary(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
