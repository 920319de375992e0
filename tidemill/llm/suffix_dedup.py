"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if it is covered by a string of LENGTH bytes (a window) that also starts
in a document with a smaller id. Windows are classed by their content, and a class's
smallest document keeps it.

Sorting all suffixes of a corpus would move every byte many times, so suffixes are
thinned out first, without losing any equal pair:

1. Every window is marked by the smallest hash of its GRAM-byte substrings. Equal
   windows have equal marks. Neighbouring windows with one mark form a segment.
2. Rows are dealt into chunks at random. A chunk names each of its (mark, segment
   content) pairs once, as 48 + 64 bits of hashes, with the smallest id that has it, to
   the mark's bucket. There, a pair that a smaller id has as well is a repeat as a
   whole; a mark with a single segment content needs no further work. Within a chunk
   equal pairs are verified byte by byte; between chunks the 112 bits decide.
3. For marks with several contents, one text per content goes to the suffix sort: all
   its windows are sorted by mergesort. Two suffixes are compared by their longest
   common extension, found by binary search over prefix polynomial hashes. Neighbours
   that agree on LENGTH bytes by hash are verified byte by byte; each class's smallest
   document decides which windows are repeats.
4. A mark with very many contents (around a very common line) would gather in one
   bucket. Its chunks send single windows instead, dealt by their content, each once,
   and these are sorted and verified in the same way. So are marks whose pairs collide.

What a bucket gets of a mark or window is one entry a chunk at most, however often a
passage occurs, and there are at most MOST_CHUNKS chunks: beyond, chunks grow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import polyhash
from tidemill.llm.common import documents, give_back, id_and_text, own_worker, prepare
from tidemill.llm.polyhash import ODD, mix, prefix_hashes, span_hashes, window_hashes

LENGTH, GRAM = 50, 26
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20  # text a chunk holds; text whose segments a bucket gets
MOST_CHUNKS = 1 << 20
CROWD, CROWD_ALL = 64, 1024  # contents of a mark that one chunk may name, and that all may
SLICE = 4 << 20  # bytes of a long text that are hashed at once
WINDOW_BYTES = 1 << 20  # windows verified at once
NEW, REPEAT, SORT, SINGLE = 0, 1, 2, 3  # what a bucket says about a segment
_48 = np.uint64(16)
_CROWDED = np.uint64((1 << 64) - 1)
_ENTRY = 22  # bytes of an entry: mark, content, smallest id


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def segments_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mark in 48 bits, content, first window, windows) of a text's segments."""
    found = []
    last = len(raw) - LENGTH + 1
    for a in range(0, max(0, last), SLICE):
        b = min(last, a + SLICE)
        part = raw[a : b + LENGTH - 1]
        prefix = prefix_hashes(part)
        low = sliding_minimum(mix(window_hashes(prefix, GRAM)), LENGTH - GRAM + 1)
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        end = np.append(start[1:], len(low))
        content = mix(span_hashes(prefix, start, end + LENGTH - 1) * ODD + (end - start).astype(np.uint64))
        found.append((mix(low[start]) >> _48, content, start + a, end - start))
    if not found:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    out = np.zeros(len(sorted_columns[0]), bool)
    out[:1] = True
    for c in sorted_columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _order(mark: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by mark, then by the other columns, then by position. Most marks occur
    once, so only the others are sorted by more than the mark."""
    order = np.argsort(mark)
    tied = ~_starts(mark[order])
    tied[:-1] |= tied[1:]
    k = np.flatnonzero(tied)
    rows = order[k]
    order[k] = rows[np.lexsort((rows, *(c[rows] for c in reversed(then)), mark[rows]))]
    return order


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those from start[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


@dataclass
class Chunk:
    """Some documents, by id (and text, for rows that share one)."""

    ids: np.ndarray
    texts: list[bytes]

    @classmethod
    def of(cls, table: pa.Table) -> Chunk:
        ids, texts = table["doc_id"].to_numpy(), [t.encode("utf-8", "replace") for t in table["text"].to_pylist()]
        place = sorted(range(len(texts)), key=lambda k: (ids[k], texts[k]))
        self = cls(ids[place], [texts[k] for k in place])
        self.place = place  # where the documents are in the table
        self.flat = np.frombuffer(b"".join(self.texts), np.uint8)
        self.base = np.cumsum([0, *map(len, self.texts)])
        self.raw = [self.flat[a:b] for a, b in zip(self.base[:-1], self.base[1:], strict=True)]
        found = [segments_of(r) for r in self.raw]
        row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        mark, content, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        # entries: the distinct (mark, content) pairs, sorted; their first segment is of the smallest id
        order = _order(mark, content)
        new = _starts(mark[order], content[order])
        kind = np.cumsum(_starts(mark[order])) - 1
        crowded = np.bincount(kind, new) > CROWD if len(kind) else np.zeros(0, bool)
        again = np.flatnonzero(~new)
        if len(again):  # pairs that agree by hash only make their mark a crowded one
            like = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[again]
            at = self.base[row] + start
            crowded[kind[again[~self.same(at[order[again]], at[order[like]], count[order[again]], count[order[like]])]]] = True
        if crowded.any():  # a mark with a crowd of contents is named once, as crowded
            content = content.copy()
            content[order[crowded[kind]]] = _CROWDED
            order = _order(mark, content)
        self.mark, self.content = mark[order], content[order]
        del mark, content
        self.row, self.start, self.count = row[order], start[order], count[order]
        new = _starts(self.mark, self.content)
        self.first = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1
        return self

    def same(self, i: np.ndarray, j: np.ndarray, windows_i: np.ndarray, windows_j: np.ndarray) -> np.ndarray:
        """Whether the segments that start at i and at j in all texts are equal in bytes."""
        out = windows_i == windows_j
        todo = np.flatnonzero(out)
        size = windows_i[todo] + LENGTH - 1
        for part in np.split(np.arange(len(todo)), np.flatnonzero(np.diff(np.cumsum(size) // WINDOW_BYTES)) + 1):
            if len(part):
                n = size[part]
                differs = self.flat[_spread(i[todo[part]], n)] != self.flat[_spread(j[todo[part]], n)]
                out[todo[part]] = ~np.logical_or.reduceat(differs, np.cumsum(n) - n)
        return out

    def entries(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, packed entries) for every bucket that gets some."""
        mark, content, least = self.mark[self.first], self.content[self.first], self.ids[self.row[self.first]]
        bucket = _bucket(mark, buckets)
        cut = [*np.flatnonzero(_starts(bucket)).tolist(), len(bucket)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(bucket[a]), _pack(mark[a:b], content[a:b], least[a:b])

    def candidates(self, codes: np.ndarray, buckets: int):
        """For each bucket of the suffix sort: (bucket, mark, row, start, windows), the
        texts that go there, in an order that only depends on the chunk and the codes."""
        if not len(codes):
            return
        at = self.first[codes == SORT]
        bucket = _bucket(self.mark[at], buckets)
        for b in np.unique(bucket):
            k = at[bucket == b]
            yield int(b), self.mark[k], self.row[k], self.start[k], self.count[k]
        # single windows, each content once, from the smallest id
        k = np.flatnonzero(codes[self.entry] == SINGLE)
        if len(k):
            key, row, start, group = self.single_windows(k)
            new = _starts(group)
            key, row, start = key[new], row[new], start[new]
            bucket = _bucket(key, buckets)
            for b in np.unique(bucket):
                m = bucket == b
                yield buckets + int(b), key[m], row[m], start[m], np.ones(int(m.sum()), np.int64)

    def single_windows(self, segments: np.ndarray):
        """(key, row, start, group) of all windows of these segments, by key. The windows
        of a group are equal; a collision of keys may leave equal windows in two groups,
        which both go to the sort."""
        row = np.repeat(self.row[segments], self.count[segments])
        start = _spread(self.start[segments], self.count[segments])
        key = np.zeros(len(row), np.uint64)
        order = np.argsort(row, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
            raw, at = self.raw[row[part[0]]], start[part]
            low, high = int(at.min()), int(at.max()) + LENGTH
            key[part] = mix(span_hashes(prefix_hashes(raw[low:high]), at - low, at - low + LENGTH)) >> _48
        order = np.lexsort((start, row, key))
        key, row, start = key[order], row[order], start[order]
        new = _starts(key)
        again = np.flatnonzero(~new)
        at, one = self.base[row] + start, np.ones(len(again), np.int64)
        new[again] = ~self.same(at[again], at[again - 1], one, one)
        return key, row, start, np.cumsum(new) - 1

    def repeats(self, codes: np.ndarray, flags: dict[int, np.ndarray], buckets: int) -> list[np.ndarray]:
        """The starts of each document's repeated windows."""
        if not len(codes):
            return [np.zeros(0, np.int64) for _ in self.texts]
        ids = self.ids[self.row]
        code = codes[self.entry]
        whole = (code == REPEAT) | ((code != SINGLE) & (ids > ids[self.first][self.entry]))
        rows = [np.repeat(self.row[whole], self.count[whole])]
        starts = [_spread(self.start[whole], self.count[whole])]
        # windows that the sort found in smaller ids, for every segment of the same document and content
        sorted_flags: dict[int, np.ndarray] = {}
        at = self.first[codes == SORT]
        bucket = _bucket(self.mark[at], buckets)
        for b in np.unique(bucket):
            k = at[bucket == b]
            for s, f in zip(k.tolist(), np.split(flags[int(b)], np.cumsum(self.count[k])[:-1]), strict=True):
                if f.any():
                    sorted_flags[int(self.entry[s])] = np.flatnonzero(f)
        hit = np.zeros(len(codes), bool)
        hit[list(sorted_flags)] = True
        for s in np.flatnonzero(hit[self.entry] & ~whole):
            f = sorted_flags[int(self.entry[s])]
            rows.append(np.full(len(f), self.row[s]))
            starts.append(self.start[s] + f)
        k = np.flatnonzero(code == SINGLE)
        if len(k):
            key, row, start, group = self.single_windows(k)
            first = np.flatnonzero(_starts(group))
            found = np.zeros(len(first), bool)
            bucket = _bucket(key[first], buckets)
            for b in np.unique(bucket):
                found[bucket == b] = flags[buckets + int(b)]
            again = found[group] | (self.ids[row] > self.ids[row[first]][group])
            rows.append(row[again])
            starts.append(start[again])
        row, start = np.concatenate(rows), np.concatenate(starts)
        order = np.argsort(row, kind="stable")
        return np.split(start[order], np.cumsum(np.bincount(row, minlength=len(self.texts)))[:-1])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)).astype(np.int64) * buckets) >> 32


def _pack(mark: np.ndarray, content: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Entries as bytes, first the lowest byte of all marks, then the next: the high
    bytes hardly change along sorted marks and among ids, so they compress."""
    planes = [v.astype("<i8" if v.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8).T[:n] for v, n in ((mark, 6), (content, 8), (least, 8))]
    return np.concatenate(planes).reshape(-1)


def _unpack(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marks, contents, smallest ids) of packed entries."""
    planes = raw.reshape(_ENTRY, -1)
    mark, content, least = (np.zeros((planes.shape[1], 8), np.uint8) for _ in range(3))
    mark[:, :6], content[:], least[:] = planes[:6].T, planes[6:14].T, planes[14:].T
    return mark.reshape(-1).view("<u8").astype(np.uint64), content.reshape(-1).view("<u8").astype(np.uint64), least.reshape(-1).view("<i8").astype(np.int64)


def judge_segments(marks: np.ndarray, contents: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The code of every entry of a bucket; least is the smallest id of its chunk that has it."""
    order = _order(marks, contents, least)
    mark, content, own = marks[order], contents[order], least[order]
    new_pair, new_mark = _starts(mark, content), _starts(mark)
    group, pair = np.cumsum(new_mark) - 1, np.cumsum(new_pair) - 1
    kinds = np.bincount(group, new_pair) if len(group) else np.zeros(0)
    crowded = kinds > CROWD_ALL
    crowded[group[content == _CROWDED]] = True
    code = np.where(own > own[new_pair][pair], REPEAT, np.where(kinds[group] > 1, SORT, NEW))
    out = np.zeros(len(order), np.uint8)
    out[order] = np.where(crowded[group], SINGLE, code)
    return out


class SuffixSort:
    """Windows of many texts, sorted within classes of equal mark and first bytes."""

    def __init__(self, raw: np.ndarray, start: np.ndarray):
        self.raw, self.prefix, self.start = raw, prefix_hashes(raw), start
        self.whole = span_hashes(self.prefix, start, start + LENGTH)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common extension of the suffixes at i and j, up to LENGTH bytes, by binary
        search over the hashes of their prefixes."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), LENGTH)
        for _ in range(LENGTH.bit_length()):
            middle = (low + high + 1) // 2
            same = span_hashes(self.prefix, i, i + middle) == span_hashes(self.prefix, j, j + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffixes x come before suffixes y; those that agree throughout are
        told apart from the others by their whole hash, without a search."""
        out = np.full(len(x), or_equal)
        k = np.flatnonzero(self.whole[x] != self.whole[y])
        i, j = self.start[x[k]], self.start[y[k]]
        n = np.minimum(self.extension(i, j), LENGTH - 1)
        out[k] = self.raw[i + n] < self.raw[j + n]
        return out

    def sort(self, order: np.ndarray, group_start: np.ndarray, group_size: np.ndarray) -> np.ndarray:
        """Mergesort of order's slices [group_start, + group_size), all slices at once.
        A merge finds each suffix's rank in the other run by binary search."""
        order = order.copy()
        if len(group_start):  # groups that agree throughout are sorted as they are
            whole = self.whole[order]
            mixed = np.minimum.reduceat(whole, group_start) != np.maximum.reduceat(whole, group_start)
            group_start, group_size = group_start[mixed], group_size[mixed]
        width = 1
        while len(group_size) and width < group_size.max():
            wide = group_size > width
            begin, size = group_start[wide], group_size[wide]
            place = _spread(begin, size)
            offset = place - np.repeat(begin, size)
            total = np.repeat(size, size)
            run = offset // (2 * width) * (2 * width)
            left = offset - run < width
            base = place - offset + run
            other = np.where(left, base + width, base)
            length = np.clip(np.where(left, np.minimum(total - run - width, width), width), 0, None)
            suffix = order[place]
            low, high = np.zeros(len(place), np.int64), length.copy()
            todo = np.flatnonzero(low < high)
            while len(todo):
                middle = (low[todo] + high[todo]) // 2
                them = order[other[todo] + middle]
                mine = suffix[todo]
                is_left = left[todo]
                # the left run comes first among equals
                before = np.zeros(len(todo), bool)
                before[is_left] = self.less(them[is_left], mine[is_left], False)
                before[~is_left] = self.less(them[~is_left], mine[~is_left], True)
                low[todo] = np.where(before, middle + 1, low[todo])
                high[todo] = np.where(before, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            own = offset - run - np.where(left, 0, width)
            merged = order.copy()
            merged[base + own + low] = order[place]
            order = merged
            width *= 2
        return order

    def same(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether windows x and y are equal: by hash, then verified by bytes."""
        out = self.whole[x] == self.whole[y]
        i, j = self.start[x], self.start[y]
        k = np.flatnonzero(out)
        step = np.arange(LENGTH)
        for a in range(0, len(k), WINDOW_BYTES // LENGTH):
            part = k[a : a + WINDOW_BYTES // LENGTH]
            out[part] = (self.raw[i[part, None] + step] == self.raw[j[part, None] + step]).all(1)
        return out


def repeated_windows(marks: np.ndarray, docs: np.ndarray, windows: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For texts that lie one after the other in raw (each windows + LENGTH - 1 bytes
    long): for each window whether a text of the same mark and a smaller document has it."""
    size = windows + LENGTH - 1
    start = _spread(np.cumsum(size) - size, windows)
    mark, doc = np.repeat(marks, windows), np.repeat(docs, windows)
    head = np.zeros(len(start), np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | raw[start + k]
    order = np.lexsort((head, mark))
    begin = np.flatnonzero(_starts(mark[order], head[order]))
    sorter = SuffixSort(raw, start)
    order = sorter.sort(order, begin, np.diff(np.append(begin, len(order))))
    new = np.zeros(len(order), bool)
    new[begin] = True
    k = np.flatnonzero(~new)
    new[k] = ~sorter.same(order[k], order[k - 1])
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)
    out = np.zeros(len(order), bool)
    out[order] = doc[order] > least[np.cumsum(new) - 1]
    return out


def _codes(replies: pa.Table) -> np.ndarray:
    rows = sorted((r for r in replies.select(["kind", "bucket", "data"]).to_pylist() if r["kind"] == 0), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r["data"], np.uint8) for r in rows)])


def enter() -> None:
    """Start work on a group: what the last one freed goes back first."""
    own_worker("suffix sort", polyhash.forget)
    give_back()


REPLY = "chunk long, kind int, bucket int, data binary"


def _apply(docs: DataFrame, finish, schema, chunk_bytes: int, bucket_bytes: int) -> DataFrame:
    """finish(chunk, starts of repeated windows by document, the chunk's rows) -> table, for
    each chunk. docs has doc_id, text and perhaps columns that finish wants back."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = min(MOST_CHUNKS, max(1, -(-size // chunk_bytes))), max(1, -(-size // bucket_bytes))
    # by the row's place too: rows may share an id
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(chunks)))

    def name_entries(key: tuple, table: pa.Table) -> pa.Table:
        enter()
        found = list(Chunk.of(table).entries(buckets))
        number = [key[0].as_py()] * len(found)
        return pa.table({"bucket": pa.array([f[0] for f in found], pa.int32()), "chunk": pa.array(number, pa.int64()), "entries": pa.array([f[1].tobytes() for f in found], pa.binary())})

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        enter()
        packed = [np.frombuffer(e, np.uint8) for e in table["entries"].to_pylist()]
        sizes = [len(p) // _ENTRY for p in packed]
        code = judge_segments(*(np.concatenate(x) for x in zip(*map(_unpack, packed), strict=True)))
        data = [c.tobytes() for c in np.split(code, np.cumsum(sizes)[:-1])]
        n = table.num_rows
        return pa.table({"chunk": table["chunk"], "kind": pa.array([0] * n, pa.int32()), "bucket": pa.array([key[0].as_py()] * n, pa.int32()), "data": pa.array(data, pa.binary())})

    def name_candidates(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        enter()
        out: dict[str, list] = {c: [] for c in ("bucket", "chunk", "marks", "docs", "windows", "raw")}
        if table.num_rows:
            chunk = Chunk.of(table)
            for bucket, mark, row, start, count in chunk.candidates(_codes(replies), buckets):
                texts = (chunk.texts[r][s : s + n + LENGTH - 1] for r, s, n in zip(row.tolist(), start.tolist(), count.tolist(), strict=True))
                for c, v in zip(out, (bucket, key[0].as_py(), mark.tobytes(), chunk.ids[row].tobytes(), count.astype(np.int64).tobytes(), b"".join(texts)), strict=True):
                    out[c].append(v)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    def sort_windows(key: tuple, table: pa.Table) -> pa.Table:
        enter()
        columns = {c: [np.frombuffer(x, k) for x in table[c].to_pylist()] for c, k in (("marks", np.uint64), ("docs", np.int64), ("windows", np.int64), ("raw", np.uint8))}
        flags = repeated_windows(*(np.concatenate(columns[c]) for c in ("marks", "docs", "windows", "raw")))
        cut = np.cumsum([int(w.sum()) for w in columns["windows"]])[:-1]
        data = [np.packbits(f).tobytes() for f in np.split(flags, cut)]
        n = table.num_rows
        return pa.table({"chunk": table["chunk"], "kind": pa.array([1] * n, pa.int32()), "bucket": pa.array([key[0].as_py()] * n, pa.int32()), "data": pa.array(data, pa.binary())})

    def close(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        enter()
        chunk = Chunk.of(table)
        codes = _codes(replies)
        packed = {r["bucket"]: np.frombuffer(r["data"], np.uint8) for r in replies.to_pylist() if r["kind"] == 1}
        sizes = {b: int(count.sum()) for b, _, _, _, count in chunk.candidates(codes, buckets)}
        flags = {b: np.unpackbits(packed[b], count=n).astype(bool) for b, n in sizes.items()}
        return finish(chunk, chunk.repeats(codes, flags, buckets), table)

    by_chunk = dealt.groupBy("chunk")
    entries = by_chunk.applyInArrow(name_entries, "bucket int, chunk long, entries binary")
    codes = entries.groupBy("bucket").applyInArrow(judge, REPLY)
    named = by_chunk.cogroup(codes.groupBy("chunk")).applyInArrow(name_candidates, "bucket int, chunk long, marks binary, docs binary, windows binary, raw binary")
    flags = named.groupBy("bucket").applyInArrow(sort_windows, REPLY)
    return by_chunk.cogroup(codes.unionByName(flags).groupBy("chunk")).applyInArrow(close, schema)  # all uses of dealt share one exchange


def removed_bytes(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n bytes the windows at these starts cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + LENGTH, -1)
    return np.cumsum(step[:n]) > 0


def mark_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs.

    Null and empty texts, and those under LENGTH bytes, lose nothing. Rows that share
    a doc_id lose nothing to each other. A row with a null doc_id has no order: it
    loses nothing and no other row loses anything to it. Other columns are ignored;
    an empty table gives an empty result; texts of any length are hashed in slices.
    """
    prepare(docs.sparkSession)
    docs = id_and_text(docs)

    def finish(chunk: Chunk, repeats: list[np.ndarray], table: pa.Table) -> pa.Table:
        rows = []
        for raw, starts in zip(chunk.raw, repeats, strict=True):
            gone = removed_bytes(len(raw), starts) if len(starts) else None
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if gone is not None else 0
            kept = raw[~gone] if gone is not None else raw
            rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        columns = list(zip(*rows, strict=True))
        return pa.table({"doc_id": pa.array(chunk.ids), "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = _apply(docs.filter("doc_id IS NOT NULL"), finish, schema, chunk_bytes, bucket_bytes)
    none = F.lit(0).cast("long")
    unordered = docs.filter("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return found.unionByName(unordered)


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs without the repeated passages in `text`; n_chars follows where there is
    such a column, all other columns stay. A character that a removed run cuts into
    goes with it. Rows without a text or doc_id stay as they are."""
    prepare(docs.sparkSession)
    # the other columns travel with the text, as one column that cannot clash
    others = [c for c in docs.columns if c != "text"]
    packed = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("empty"), F.struct(*others).alias("others"))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType()), packed.schema["empty"], packed.schema["others"]])

    def finish(chunk: Chunk, repeats: list[np.ndarray], table: pa.Table) -> pa.Table:
        out = [raw[~removed_bytes(len(raw), starts)].tobytes().decode("utf-8", "ignore") if len(starts) else text.decode() for raw, starts, text in zip(chunk.raw, repeats, chunk.texts, strict=True)]
        kept = table.select(["empty", "others"]).take(pa.array(chunk.place, pa.int64()))
        return pa.table({"text": pa.array(out, pa.string()), "cut": pa.array([len(s) > 0 for s in repeats], pa.bool_()), "empty": kept["empty"], "others": kept["others"]})

    found = _apply(packed, finish, schema, chunk_bytes, bucket_bytes)
    text = F.when(~F.col("empty"), F.col("text"))
    column = lambda c: text if c == "text" else F.col("others")[c] if c != "n_chars" else F.when(F.col("cut"), F.length("text")).otherwise(F.col("others")[c]).cast(docs.schema[c].dataType)
    return found.select(*[column(c).alias(c) for c in docs.columns]).unionByName(docs.filter("doc_id IS NULL"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 49)) AS p, h FROM d WHERE len(h) >= 100),
s AS (SELECT r, doc_id, p, array_slice(h, 2 * p + 1, 2 * p + 100) AS win FROM w),
f AS (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY win) AS least FROM s),
g AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM f WHERE doc_id > least),
q AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM g),
runs AS (SELECT r, run, min(p) AS a, max(p) + 50 AS b FROM q GROUP BY r, run),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM runs),
cut AS (SELECT d.r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
