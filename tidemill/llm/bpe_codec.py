"""BPE encoding and decoding by per-prefix dynamic programming.

An automaton over all tokens lists, at each position of a pre-token, the tokens
that end there. For every prefix exactly one of them is the last token of the
prefix's encoding: the one whose start has a solved prefix and which is compatible
with that prefix's last token. Following the back-pointers from the end gives the
ids.

Two neighbouring tokens are compatible if merging their joint bytes leaves the
border between them alone. While their merge trees are built up, the border sees
the right spine of the left token and the left spine of the right token; it breaks
as soon as the two symbols at it form a pair that is merged before either of them
grows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.byte_bpe import PretokenTable, slices, vocabulary
from tidemill.llm.common import by_bytes, documents, id_and_text, own_worker, prepare, small_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NEVER = 1 << 40


class Encoder:
    def __init__(self, path: str, pair_cache: int = 1_000_000):
        vocab = self.vocab = vocabulary(path)
        special = set(vocab.specials.values())
        self.rank = {i: _NEVER for i in vocab.token_bytes}
        self.rank |= {new: rank for rank, new in vocab.merge_rank.values()}
        self.known: dict[int, bool] = {}
        self.pair_cache = pair_cache
        self.spines: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.own: dict[int, bool] = {}  # one entry per token of the vocabulary
        # a token whose bytes encode to others can end no prefix
        self.whole = {b.decode("latin-1"): i for i, b in vocab.token_bytes.items() if i not in special and self.is_own(i)}
        self.automaton = ahocorasick.Automaton()
        self.length = np.zeros(max(vocab.token_bytes) + 1, np.int64).tolist()
        for text, i in self.whole.items():
            self.automaton.add_word(text, (i, len(text)))
            self.length[i] = len(text)
        self.automaton.make_automaton()

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The nodes on one side of a token's merge tree, from its byte up:
        (node, rank at which it appears, rank at which it is merged into the next)."""
        found = self.spines.get((token, side))
        if found is None:
            nodes = [token]
            while (below := int(self.vocab.parts[nodes[-1], side])) >= 0:
                nodes.append(below)
            nodes.reverse()
            born = [-1, *(self.rank[n] for n in nodes[1:])]
            found = self.spines[token, side] = [(n, b, e) for n, b, e in zip(nodes, born, [*born[1:], _NEVER], strict=True)]
        return found

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.known.get(key)
        if found is None:
            if len(self.known) > self.pair_cache:
                self.known.clear()
            found = self.known[key] = self._stays_apart(left, right)
        return found

    def _stays_apart(self, left: int, right: int, halves: bool = False) -> bool:
        """Whether the border between two symbols stays until both are whole, and after
        that too unless they are the halves of a token, which then merge."""
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        merge_rank = self.vocab.merge_rank
        while True:
            (x, _, x_ends), (y, _, y_ends) = a[i], b[j]
            if halves and x_ends == _NEVER and y_ends == _NEVER:
                return True
            found = merge_rank.get((x, y))
            # of equal pairs in a row the leftmost is merged first
            if found is not None and found[0] < x_ends and found[0] <= y_ends:
                return False
            if x_ends == _NEVER and y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            if y_ends <= x_ends:
                j += 1

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        text = word.decode("latin-1")
        if (token := self.whole.get(text)) is not None:
            return [token]
        last = [-1] * len(text)
        known, compatible = self.known, self.compatible
        for end, (token, size) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            before = end - size
            if before < 0:
                last[end] = token
            elif (prior := last[before]) >= 0:
                fits = known.get(prior << 20 | token)
                if compatible(prior, token) if fits is None else fits:
                    last[end] = token
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.length[last[at]]
        out.reverse()
        return out

    def is_own(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself."""
        found = self.own.get(token)
        if found is None:
            a, b = self.vocab.parts[token].tolist()
            found = self.own[token] = a < 0 or (self.is_own(a) and self.is_own(b) and self._stays_apart(a, b, halves=True))
        return found

    def solve(self, words: list[str]):
        found = [self.encode(w.encode("utf-8", "replace")) for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.fromiter((i for f in found for i in f), np.uint32, int(lengths.sum()))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[Encoder, PretokenTable, np.ndarray, np.ndarray]:
    encoder = Encoder(path)
    tokens = [encoder.vocab.token_bytes.get(i, b"") for i in range(max(encoder.vocab.token_bytes) + 1)]
    ends = np.cumsum([len(t) for t in tokens])
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    return encoder, PretokenTable(encoder.solve, encoder.vocab.specials), flat, np.concatenate([[0], ends])


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text as unsigned 32-bit integers."""
    table = _encoder(path)[1]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for lo, hi in by_bytes(texts):
        pieces = [(k, s) for k in range(lo, hi) for s in slices(texts[k])]
        for (k, _), rows in zip(pieces, table.rows([s for _, s in pieces]), strict=True):
            out[k].append(table.gather(rows))
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in out]


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    _, _, flat, start = _encoder(path)
    ids = ids.astype(np.int64)
    lengths = start[ids + 1] - start[ids]
    ends = np.cumsum(lengths)
    if not len(ends):
        return ""
    return flat[np.arange(ends[-1]) + np.repeat(start[ids] - (ends - lengths), lengths)].tobytes().decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id and text with `ids array<int>`, the encoding of the whole text."""
    prepare(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("byte-pair codec", _encoder.cache_clear)
        for batch in small_batches(it):
            texts = batch.column("text").to_pylist()
            for lo, hi in by_bytes(texts):
                ids = encode_texts(texts[lo:hi], path)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("text")[lo:hi], pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], ["doc_id", "text", "ids"])

    return id_and_text(docs).mapInArrow(batches, "doc_id long, text string, ids array<int>")


def bpe_roundtrip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the decoded text), one row per row of docs.

    Null and empty texts have no ids and decode to the empty text. A null doc_id
    stays null, repeated rows give repeated results, other columns are ignored, an
    empty table gives an empty result, texts of any length are cut into slices.
    """
    prepare(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("byte-pair codec", _encoder.cache_clear)
        for batch in small_batches(it):
            texts = batch.column("text").to_pylist()
            for lo, hi in by_bytes(texts):
                ids = encode_texts(texts[lo:hi], path)
                digests = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
                decoded = [hashlib.sha256(decode_ids(i, path).encode()).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array([len(i) for i in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(batches, SCHEMA)


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_roundtrip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
