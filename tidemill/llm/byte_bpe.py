"""A byte-level BPE vocabulary as arrays, and the split of texts into pre-tokens.

The file's vocabulary writes each byte as one printable character; `byte_chars`
rebuilds that alphabet from its rule. Ids of merged tokens follow merge order.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

NO_RANK = np.int32(2**31 - 1)

# The pre-token pattern of the byte-level vocabulary. White space is
# spelled out, since the regex module counts four control characters as well.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_CUT = regex.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def byte_chars() -> dict[str, int]:
    """Character -> byte: printable Latin-1 stands for itself, every other byte, in
    order, for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    byte_id: np.ndarray  # byte -> id
    token_bytes: dict[int, bytes]  # id -> bytes, special tokens too
    parts: np.ndarray  # id -> the two ids it is merged from, or -1
    merge_rank: dict[tuple[int, int], tuple[int, int]]  # pair -> rank, merged id
    specials: dict[str, int]
    keys: np.ndarray  # open-addressing table of pairs
    ranks: np.ndarray
    merged: np.ndarray  # rank -> id

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NO_RANK where there is none."""
        want = (left.astype(np.int64) << 20) | right
        mask = len(self.keys) - 1
        slot = _slot(want, mask)
        held = self.keys[slot]
        out = np.where(held == want, self.ranks[slot], NO_RANK)
        todo = np.flatnonzero((held != want) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            held = self.keys[slot[todo]]
            hit = held == want[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[(held >= 0) & ~hit]
        return out


def _slot(key: np.ndarray, mask: int) -> np.ndarray:
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) & np.uint64(mask)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, chars = spec["model"], byte_chars()
    ids = model["vocab"]
    token_bytes = {i: bytes(chars[c] for c in token) for token, i in ids.items()}
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes |= {i: text.encode() for text, i in specials.items()}
    byte_id = np.zeros(256, np.int64)
    for c, b in chars.items():
        byte_id[b] = ids[c]
    parts = np.full((max(token_bytes) + 1, 2), -1, np.int64)
    merge_rank = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merge_rank[ids[a], ids[b]] = (rank, ids[a + b])
        parts[ids[a + b]] = ids[a], ids[b]
    slots = 1 << (len(merge_rank) * 8).bit_length()
    keys, ranks = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
    pairs = np.array([(a << 20) | b for a, b in merge_rank], np.int64)
    for key, slot, (rank, _) in zip(pairs.tolist(), _slot(pairs, slots - 1).tolist(), merge_rank.values(), strict=True):
        while keys[slot] >= 0:
            slot = (slot + 1) & (slots - 1)
        keys[slot], ranks[slot] = key, rank
    merged = np.array([new for _, new in merge_rank.values()], np.int64)
    return Vocabulary(byte_id, token_bytes, parts, merge_rank, specials, keys, ranks, merged)


def slices(text: str, limit: int = 1 << 20):
    """Cut a very long text before single spaces between words: pre-tokens never
    cross such a place, so memory stays bounded."""
    start = 0
    while len(text) - start > limit:
        cut = _CUT.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


@functools.lru_cache(maxsize=1)
def _newer() -> np.ndarray:
    """By code point: whether the regex module may know it as a letter or digit while
    an older Unicode table does not, being unassigned in Python's own table."""
    unassigned = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in regex.findall(r"[\p{L}\p{N}]", unassigned)]] = True
    return out


def _split(text: str) -> list[str]:
    if text.isascii() or not _newer()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")].any():
        return PRETOKEN.findall(text)
    return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]


def pretokens(text: str, specials: dict[str, int]) -> list[str]:
    """Pre-tokens in order; a special string is an item of its own."""
    if not any(s in text for s in specials):
        return _split(text)
    out: list[str] = []
    for piece in regex.split("(" + "|".join(regex.escape(s) for s in specials) + ")", text):
        out.extend([piece] if piece in specials else _split(piece))
    return out


class PretokenTable:
    """Maps pre-tokens to row numbers of what `solve` has found for them. Solving
    runs on the new pre-tokens of a batch at once; the table starts anew when it holds
    more than `capacity` of them, or `characters` in all (results do not change, only
    memory is bounded: by that and what one batch adds)."""

    def __init__(self, solve, specials: dict[str, int], split=None, capacity: int = 400_000, characters: int = 16_000_000):
        self.solve, self.specials, self.capacity, self.characters = solve, specials, capacity, characters
        self.split = split or (lambda text: pretokens(text, specials))
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.held = 0
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the row numbers of its pre-tokens. A row's ids are
        flat[start[row]:start[row + 1]]."""
        if len(self.row) > self.capacity or self.held > self.characters:
            self.clear()
        split = [self.split(t) for t in texts]
        get, none = self.row.get, itertools.repeat(-1)
        out = [np.fromiter(map(get, s, none), np.int64, len(s)) for s in split]
        open_at = [np.flatnonzero(r < 0) for r in out]
        new = list({s[k] for s, at in zip(split, open_at, strict=True) for k in at.tolist()})
        if new:
            self._add(new)
            row = self.row
            for s, r, at in zip(split, out, open_at, strict=True):
                r[at] = [row[s[k]] for k in at.tolist()]
        return out

    def _add(self, new: list[str]) -> None:
        plain = [x for x in new if x not in self.specials]
        marks = [x for x in new if x in self.specials]
        lengths, flat = self.solve(plain)
        lengths = np.concatenate([lengths, np.ones(len(marks), np.int64)])
        flat = np.concatenate([flat, np.array([self.specials[x] for x in marks], np.uint32)])
        at = len(self.row)
        self.held += sum(map(len, new))
        self.row.update(zip(plain + marks, range(at, at + len(new)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows, one after the other."""
        lengths = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.uint32)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[rows] - (ends - lengths), lengths)]
