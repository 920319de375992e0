"""Packing by power-of-two decomposition.

A document of n tokens gives n // cap pieces of cap tokens and, for the rest, one
piece per set bit of it. Every piece is a sequence of its own, so no sequence
crosses documents and none needs padding; the bucket (log2 of the length) groups
sequences of equal length, which is how a trainer forms its batches.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.byte_bpe import PretokenTable, slices
from tidemill.llm.common import by_bytes, documents, id_and_text, own_worker, prepare, small_batches

END_ID = 2
CAP = 4096
_WORD = re.compile("[^\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# The vocabulary's split of lower-cased text, for Latin-1 texts.
_LATIN = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[{_DIGITS}]|[^\\t-\\r \x85\xa0{_LATIN}{_DIGITS}]+")
_BEYOND = re.compile("[^\x00-\xff]")


class Tokenization:
    """The library's ids of whole texts, looked up by pre-token.

    The vocabulary drops white space and none of its steps looks across it. A Latin-1
    text (nothing to normalise but its case) is split into pre-tokens here; new ones
    are encoded by the library in one string, where each ends with the only token
    that carries the end-of-word mark. Any other text is encoded by the library word
    by word, with what normalisation and splitting it does. The fast calls give the
    same ids and leave out the offsets, which nothing here reads.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.latin = PretokenTable(self._joined, {}, lambda text: _PRETOKEN.findall(text.lower()), 350_000)
        self.other = PretokenTable(self._single, {}, _WORD.findall, 100_000)

    def _single(self, words: list[str]):
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return lengths, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))

    def _joined(self, words: list[str]):
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            return self._single(words)
        return np.diff(last, prepend=-1), ids

    def ids(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each text the ids of its slices."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        pieces = [(k, s) for k, t in enumerate(texts) for s in slices(t)]
        plain = [not _BEYOND.search(s) and not any(m in s for m in self.marks) for _, s in pieces]
        for table, wanted in ((self.latin, True), (self.other, False)):
            mine = [p for p, is_plain in zip(pieces, plain, strict=True) if is_plain == wanted]
            for (k, _), rows in zip(mine, table.rows([s for _, s in mine]), strict=True):
                out[k].append(table.gather(rows))
        return out


@functools.lru_cache(maxsize=2)
def tokenization(path: str) -> Tokenization:
    return Tokenization(path)


def token_ids(texts: list[str], path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """The ids of each whole text, with the end id."""
    end = np.array([end_id], np.uint32)
    return [np.concatenate([*x, end]) for x in tokenization(path).ids(texts)]


def piece_lengths(n: int, cap: int = CAP) -> list[int]:
    """cap as often as it fits, then the set bits of the rest from the largest."""
    rest = n % cap
    return [cap] * (n // cap) + [1 << b for b in range(cap.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, path: str, cap: int = CAP, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, bucket and, if asked for, ids.

    cap is a power of two. Each task lists the pieces of some megabytes of text by bucket
    at a time, so equal lengths lie together without a shuffle. Null and empty texts give one piece with the end id
    alone. Repeated rows are packed each; a null doc_id stays null; other columns are
    ignored; an empty table gives an empty result; there is no limit on a text.
    """
    if cap < 1 or cap & (cap - 1):
        raise ValueError("cap must be a power of two")
    prepare(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "bucket", *["ids"] * with_ids]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("packing", tokenization.cache_clear)
        for batch in small_batches(it):
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, hi in by_bytes(texts):
                found = []
                for doc_id, ids in zip(doc_ids[lo:hi], token_ids(texts[lo:hi], path, end_id), strict=True):
                    at = 0
                    for n in piece_lengths(len(ids), cap):
                        piece = ids[at : at + n].astype("<u4")
                        found.append((doc_id, at, n, zlib.crc32(piece), len(ids), 0, n.bit_length() - 1, piece.astype(np.int32)))
                        at += n
                found.sort(key=lambda x: x[6])
                columns = list(zip(*found, strict=True))
                kinds = [pa.int64()] * 6 + [pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[: len(names)], kinds, strict=False)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, bucket int" + ", ids array<int>" * with_ids
    return id_and_text(docs).mapInArrow(batches, schema).withColumn("sequence_id", F.monotonically_increasing_id())


def op10_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
