"""Token counts by rank-synchronous array merging.

All new pre-tokens of a batch lie in one ragged symbol array. Each round finds,
for every sequence, the pair of lowest merge rank and applies all its occurrences
in all sequences at once; sequences without a mergeable pair leave the array. The
count of a pre-token is the number of symbols that survive.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.byte_bpe import NO_RANK, PretokenTable, Vocabulary, slices, vocabulary
from tidemill.llm.common import by_bytes, documents, id_and_text, own_worker, prepare, small_batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merge_all(vocab: Vocabulary, words: list[bytes]) -> np.ndarray:
    """The number of symbols that each byte string is merged to."""
    counts = np.array([len(w) for w in words], np.int64)
    seq = np.flatnonzero(counts > 1)
    if not len(seq):
        return counts
    lengths = counts[seq]
    sym = vocab.byte_id[np.frombuffer(b"".join(words[k] for k in seq), np.uint8)]
    owner = np.repeat(np.arange(len(seq)), lengths)
    rank = None
    while len(sym):
        last = np.empty(len(sym), bool)
        last[:-1] = owner[1:] != owner[:-1]
        last[-1] = True
        if rank is None:
            rank = np.full(len(sym), NO_RANK, np.int32)
            at = np.flatnonzero(~last)
            rank[at] = vocab.pair_ranks(sym[at], sym[at + 1])
        first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        size = np.diff(np.append(first, len(sym)))
        least = np.minimum.reduceat(rank, first)
        done = least == NO_RANK
        if done.any():
            counts[seq[owner[first[done]]]] = size[done]
            keep = np.repeat(~done, size)
            sym, owner, rank, last = sym[keep], owner[keep], rank[keep], last[keep]
            size, least = size[~done], least[~done]
            if not len(sym):
                break
        hit = rank == np.repeat(least, size)
        # a pair of equal symbols can overlap itself: take every second one from the left
        double = np.flatnonzero(hit[1:] & hit[:-1])
        if len(double):
            at = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, -1))
            hit &= (at - begin) % 2 == 0
        where = np.flatnonzero(hit)
        sym[where] = vocab.merged[rank[where]]
        gone = np.zeros(len(sym), bool)
        gone[where + 1] = True
        keep = ~gone
        # only pairs that touch a merged symbol have a new rank
        moved = np.cumsum(keep)[where] - 1
        last_kept = last.copy()
        last_kept[where] = last[where + 1]
        sym, owner, rank, last = sym[keep], owner[keep], rank[keep], last_kept[keep]
        stale = np.zeros(len(sym), bool)
        stale[moved] = True
        before = moved[moved > 0] - 1
        stale[before[owner[before] == owner[before + 1]]] = True
        rank[stale] = NO_RANK
        at = np.flatnonzero(stale & ~last)
        rank[at] = vocab.pair_ranks(sym[at], sym[at + 1])
    return counts


@functools.lru_cache(maxsize=2)
def _table(path: str) -> PretokenTable:
    vocab = vocabulary(path)

    def solve(words: list[str]):
        # counts only: one number per pre-token, kept where the ids would be
        counts = merge_all(vocab, [w.encode("utf-8", "replace") for w in words])
        return np.ones(len(words), np.int64), counts.astype(np.uint32)

    return PretokenTable(solve, vocab.specials)


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text, as the library for `path` counts them."""
    table = _table(path)
    out = np.zeros(len(texts), np.int64)
    for lo, hi in by_bytes(texts):
        pieces = [(k, s) for k in range(lo, hi) for s in slices(texts[k])]
        rows = table.rows([s for _, s in pieces])
        special = {table.row[s] for s in table.specials if s in table.row}
        for (k, _), r in zip(pieces, rows, strict=True):
            n = table.flat[r].sum(dtype=np.int64)
            if special:  # a special string is one token; its slot holds its id
                at = np.isin(r, list(special))
                n += at.sum() - table.flat[r[at]].sum(dtype=np.int64)
            out[k] += n
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row of
    docs. Narrow: no shuffle, a batch at a time.

    Null and empty texts have 0 bytes and 0 tokens. A null doc_id stays null,
    repeated rows are counted each, other columns are ignored, an empty table
    gives an empty result, and texts of any length are worked through in slices.
    """
    prepare(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("token counts", _table.cache_clear)
        for batch in small_batches(it):
            texts = batch.column("text").to_pylist()
            n_tokens = count_texts(texts, path)
            n_bytes = [len(t.encode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(batches, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
