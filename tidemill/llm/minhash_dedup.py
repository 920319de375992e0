"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is a weighted set: its shingles of five words, each weighing as often as it
occurs. Darts fall on every unit of weight at random, hash-determined times, each
aimed at one of K coordinates. A signature keeps the earliest dart of each
coordinate. Only darts before a cut-off are thrown, about K ln K per text, so the
cost is one hash per shingle instead of K; where a coordinate stays empty the
cut-off is doubled. Two texts agree in a coordinate with a probability equal to
their weighted Jaccard similarity.

Bands of signature coordinates are join keys. Texts that meet in a band are
compared exactly, on all their shingles, and linked from the threshold up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import polyhash
from tidemill.llm.common import SMALL_ROWS, by_bytes, documents, id_and_text, join_by_group, materialize, only_ids, own_worker, prepare, release, small_batches
from tidemill.llm.components import connected_components, forest
from tidemill.llm.polyhash import ODD, mix, prefix_hashes, span_hashes

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
BLOCK = 1024  # texts that are compared at once,
BLOCK_CELLS = 1 << 19  # with about so many cells

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell) of all unit weights, by text: a cell is a shingle's hash
    together with which of its occurrences it is.

    Words are runs of letters, digits and _ of the lower-cased text (any character
    beyond ASCII counts as a letter). A text of one to four words has one shingle.
    """
    data = [t.lower().encode("utf-8", "replace") + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    inside = _WORD_BYTE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = mix(span_hashes(prefix_hashes(raw), start, end))
    text = np.searchsorted(np.cumsum([len(d) for d in data]), start, side="right")
    n = len(word)
    shingle, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= WORDS:
        whole = text[WORDS - 1 :] == text[: n - WORDS + 1]
        h = np.zeros(n - WORDS + 1, np.uint64)
        for k in range(WORDS):
            h = mix(h * ODD + word[k : n - WORDS + 1 + k])
        shingle, owner = h[whole], text[: n - WORDS + 1][whole]
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        h = np.full(len(short), 1, np.uint64)
        for k in range(WORDS - 1):
            has = count[short] > k
            h[has] = mix(h[has] * ODD + word[first[short[has]] + k])
        shingle, owner = np.concatenate([shingle, h]), np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])])
    at = np.arange(len(shingle))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return owner, mix(shingle + nth.astype(np.uint64) * ODD)


def signatures(owner: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """(n, K) signatures; a text without cells has all zeros."""
    out = np.zeros((n, K), np.uint64)
    weight = np.bincount(owner, minlength=n)
    todo = weight > 0
    cutoff = np.where(todo, K * (np.log(K) + 2) / np.maximum(weight, 1), 0.0)
    while todo.any():
        pick = todo[owner]
        who, seed = owner[pick], cell[pick]
        limit = cutoff[who]
        time, throw = np.zeros(len(who)), 0
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            # waiting times between a cell's darts are exponential
            salt = [np.uint64(k * int(ODD) % 2**64) for k in (2 * throw + 1, 2 * throw + 2)]
            h = mix(seed + salt[0])
            u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            near = u > np.exp(time - limit)
            who, seed, limit, time = who[near], seed[near], limit[near], time[near] - np.log(u[near])
            mark = mix(seed ^ salt[1])
            darts.append((who * K + (mark % np.uint64(K)).astype(np.int64), time, mark))
            throw += 1
        slot, when, mark = (np.concatenate(x) for x in zip(*darts, strict=True))
        order = np.lexsort((mark, when, slot))
        slot, mark = slot[order], mark[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        out.reshape(-1)[slot[first]] = mark[first]
        filled = np.bincount(slot[first] // K, minlength=n)
        todo = todo & (filled < K)
        cutoff = np.where(todo, cutoff * 2, cutoff)
    return out


def _digests(owner: np.ndarray, cell: np.ndarray, n: int) -> list[np.ndarray]:
    """A 128-bit digest of each text's set of cells, in two halves."""
    sums = []
    for salt in (np.uint64(1), np.uint64(2)):
        total = np.zeros(n, np.uint64)
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            total[owner[first]] = np.add.reduceat(mix(cell * ODD + salt), first)
        sums.append(total)
    return sums


def _two_longs(digests: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(x.view(np.int64)) for x in digests]


KEY = ["doc_id", "d0", "d1"]  # a text: a document's id and the digest of its weighted set


def _signed(docs: DataFrame) -> DataFrame:
    """Key, weight and band keys of every document with at least a word."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("minhash", polyhash.forget)
        for batch in small_batches(it):
            texts = batch.column("text").to_pylist()
            for lo, hi in by_bytes(texts, 1 << 19):
                owner, cell = cells(texts[lo:hi])
                n = hi - lo
                s = signatures(owner, cell, n).reshape(n * BANDS, ROWS)
                key = np.zeros(n * BANDS, np.uint64)
                for k in range(ROWS):
                    key = mix(key * ODD + s[:, k])
                weight = np.bincount(owner, minlength=n)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), pa.array(key.view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *_two_longs(_digests(owner, cell, n)), pa.array(weight, pa.int64()), bands], [*KEY, "weight", "bands"])
                yield out.filter(pa.array(weight > 0))

    return docs.mapInArrow(batches, "doc_id long, d0 long, d1 long, weight long, bands array<long>")


def _cell_sets(docs: DataFrame) -> DataFrame:
    """Key and sorted 64-bit cells of each text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("minhash", polyhash.forget)
        for batch in small_batches(it):
            texts = batch.column("text").to_pylist()
            for lo, hi in by_bytes(texts, 1 << 19):
                owner, cell = cells(texts[lo:hi])
                digests = _digests(owner, cell, hi - lo)
                order = np.lexsort((cell, owner))
                ends = np.cumsum(np.bincount(owner, minlength=hi - lo))
                sets = [x.tobytes() for x in np.split(cell[order], ends[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *_two_longs(digests), pa.array(sets, pa.binary())], [*KEY, "cells"])

    return docs.mapInArrow(batches, "doc_id long, d0 long, d1 long, cells binary")


def joining_links(sets: list[np.ndarray], component: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) that join the components exactly as all links between these texts
    would; sets are the texts' cells.

    Texts are compared one at a time with all that are in another component and were
    not yet such a text themselves: first the text that shares most with the others
    (an original, if it is there), then those of the smallest components, until all
    that are left are of one component. A family that holds together costs a few
    comparisons a text; texts that are all apart cost every pair, as they must. A link
    needs `threshold` of a text's cells to be shared, so texts that share less with
    all others together take no part.
    """
    n, weight = len(sets), np.array([len(x) for x in sets])
    _, cell, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), weight)
    shared = times > 1
    keep = shared[cell]
    row, cell = row[keep], (np.cumsum(shared) - 1)[cell[keep]]
    begin = np.searchsorted(row, np.arange(n + 1))
    comp = np.unique(component, return_inverse=True)[1]
    waiting = np.diff(begin) >= threshold * weight - 1e-9
    meets = np.bincount(row, times[shared][cell], n)
    held = np.zeros(int(shared.sum()), bool)
    out: list[tuple[int, int]] = []
    first = True
    while True:
        w = np.flatnonzero(waiting)
        size = np.bincount(comp[w], minlength=1)
        if (size > 0).sum() < 2:
            return out
        p = int(w[meets[w].argmax()] if first else w[size[comp[w]].argmin()])
        first = False
        waiting[p] = False
        rivals = w[comp[w] != comp[p]]
        own = cell[begin[p] : begin[p + 1]]
        held[own] = True
        both = np.bincount(row[held[cell]], minlength=n)[rivals]
        held[own] = False
        hit = rivals[both >= threshold * (weight[p] + weight[rivals] - both) - 1e-9]
        for c in np.unique(comp[hit]):
            out.append((p, int(hit[comp[hit] == c][0])))
        comp[np.isin(comp, comp[hit])] = comp[p]


def _edges(entries: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """A materialized table of edges (a, b) between components. entries has slot (what
    one task gets at once), part (what is compared within it), component and a text's
    key; cells are fetched once per entry."""

    def compare(group: pa.Table) -> pa.Table:
        own_worker("minhash", polyhash.forget)
        part, component = group["part"].to_numpy(), group["component"].to_numpy()
        cells_of = group["cells"].combine_chunks()
        order = np.lexsort((component, part))
        edges = []
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if component[at[0]] != component[at[-1]]:
                found = [np.frombuffer(cells_of[int(k)].as_buffer(), np.uint64) for k in at]
                edges += [(component[at[i]], component[at[j]]) for i, j in joining_links(found, component[at], threshold)]
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        nodes, roots = forest(a, b)
        own = nodes != roots
        return pa.table({"a": pa.array(nodes[own], pa.int64()), "b": pa.array(roots[own], pa.int64())})

    rows = entries.join(sets, KEY).select("slot", "part", "component", "cells")
    return materialize(rows.groupBy("slot").applyInArrow(compare, "a long, b long"), "edges")


def _blocks(texts: Column, weight: Column) -> Column:
    """The number of blocks that so many texts of this joint weight are dealt into."""
    return F.greatest(F.ceil(texts / BLOCK), F.ceil(weight / BLOCK_CELLS)).cast("int")


def _one_block_edges(met: DataFrame, sizes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """What links within blocks: a group that fits a block is compared whole; of a
    larger one each block, together with the group's first text."""
    total = sizes.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    slots = max(1, -(-(total["n"] or 0) // BLOCK), -(-(total["weight"] or 0) // BLOCK_CELLS))
    rows = join_by_group(met, sizes.select("least", "n", "blocks", "lead"), ["least"], "n", total["n"] or 0)
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    block = F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("block", F.explode(F.when((F.struct(*KEY) == F.col("lead")) & (F.col("blocks") > 1), everywhere).otherwise(block)))
    # a slot holds several groups, or one block of a large one
    slot = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("least"), F.lit(slots))).otherwise(F.xxhash64("least", "block"))
    return _edges(rows.select(slot.alias("slot"), F.xxhash64("least", "block").alias("part"), F.col("doc_id").alias("component"), *KEY), sets, threshold)


def _block_pair_edges(met: DataFrame, large: DataFrame, found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """What links across the blocks of large groups that still hold several components:
    every text outside a group's largest component meets all other texts of the group."""
    total = large.agg(F.sum("n")).first()[0]
    rows = join_by_group(met, large.select("least", "n"), ["least"], "n", total).drop("n")
    rows = rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    crowd = materialize(rows, "crowd")
    parts = crowd.groupBy("least", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    parts = parts.groupBy("least").agg(F.max(F.struct("n", "weight", "component")).alias("main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count("*").alias("parts"))
    plan = parts.filter("parts > 1").select("least", "n", F.col("main.component").alias("main"), _blocks(F.col("n") - F.col("main.n"), F.col("weight") - F.col("main.weight")).alias("minor"), _blocks(F.col("main.n"), F.col("main.weight")).alias("major"))
    plan = materialize(plan, "plan")
    rows = join_by_group(crowd, plan, ["least"], "n", total)
    place = lambda blocks: F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")
    upto = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    with_main = lambda i, j: F.struct(F.lit(1).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(upto("minor"), lambda k: F.struct(F.lit(0).alias("kind"), F.least(k, place("minor")).alias("i"), F.greatest(k, place("minor")).alias("j")))
    minor = F.concat(among, F.transform(upto("major"), lambda j: with_main(place("minor"), j)))
    major = F.transform(upto("minor"), lambda i: with_main(i, place("major")))
    rows = rows.withColumn("meet", F.explode(F.when(F.col("component") == F.col("main"), major).otherwise(minor)))
    slot = F.xxhash64("least", "meet.kind", "meet.i", "meet.j")
    edges = _edges(rows.select(slot.alias("slot"), slot.alias("part"), "component", *KEY), sets, threshold)
    release(crowd, plan)
    return edges


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and kept for every row of docs: class_id is the smallest
    doc_id reachable over links, a link being a weighted Jaccard similarity of at
    least `threshold` on shingles of five words.

    Texts with the same weighted set of shingles are one node of the graph, so copies
    cost nothing. The texts of a bucket (a band's key) are a group, named by the
    bucket's smallest id; buckets with the same smallest id are one group, so that a
    pair is compared once and not once a band. All texts of a group are compared with
    all others unless they are connected already: no two texts that meet in a band stay
    apart if their similarity reaches the threshold. Groups are dealt in blocks of
    bounded size; no pairs leave a task, only a spanning forest. The work in a large
    group of texts that are not alike is quadratic in its size.

    Texts without a word (null and empty ones too) have no shingles, link with nothing
    and are kept, as is a row with a null doc_id, whose class_id is null. Rows that share
    a doc_id are one document: its class joins those of all its texts, and all its rows
    get the same result. Texts of any length are read whole. Other columns are ignored;
    an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = id_and_text(docs)
    signed = materialize(_signed(docs.filter("doc_id IS NOT NULL")), "signed")
    total = signed.count()
    classes = signed.groupBy("d0", "d1").agg(F.min("doc_id").alias("doc_id"), F.max("weight").alias("weight"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    nodes = classes.select(*KEY, "weight", F.posexplode("bands").alias("band", "key"))
    buckets = nodes.groupBy("band", "key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    buckets = materialize(buckets.filter("n > 1"), "buckets")
    met = join_by_group(nodes, buckets, ["band", "key"], "n", total)
    met = materialize(met.groupBy("least", *KEY).agg(F.max("weight").alias("weight")), "met")
    sizes = met.groupBy("least").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min(F.struct(*KEY)).alias("lead")).filter("n > 1")
    sizes = materialize(sizes.withColumn("blocks", _blocks(F.col("n"), F.col("weight"))), "sizes")

    involved = materialize(met.select("doc_id").distinct(), "involved")
    sets = _cell_sets(only_ids(docs, involved, ["doc_id"]))
    sets = materialize(sets.groupBy(*KEY).agg(F.first("cells").alias("cells")), "cells")
    edges = materialize(_one_block_edges(met, sizes, sets, threshold).unionByName(_same_document(signed, classes, total)), "links")
    found = connected_components(edges)
    large = sizes.filter("blocks > 1")
    if not large.isEmpty():
        across = _block_pair_edges(met, large, found, sets, threshold)
        edges = materialize(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across), "links")
        found = connected_components(edges)
    release(buckets, met, sizes, involved, sets, edges)

    grouped = classes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("d0", "d1", "copies", F.coalesce("component", "doc_id").alias("class_id"))
    members = join_by_group(signed.select(*KEY), grouped, ["d0", "d1"], "copies", total).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.select("doc_id").join(members, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _same_document(signed: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Edges that join the texts of each document whose rows hold several."""
    several = signed.groupBy("doc_id").agg(F.min("d0").alias("a"), F.max("d0").alias("b"), F.min("d1").alias("c"), F.max("d1").alias("d")).filter("a <> b OR c <> d")
    several = materialize(several.select("doc_id"), "several")
    rows = only_ids(signed.select(*KEY), several, ["doc_id"])
    joined = join_by_group(rows, classes.select("d0", "d1", "copies", F.col("doc_id").alias("first")), ["d0", "d1"], "copies", total)
    return joined.filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group, the one with the smallest doc_id; all
    columns stay, whatever their names. What near_duplicates says of null and empty
    texts, null ids, repeated rows and long texts holds: all rows of a document stay or
    go together, and rows with a null doc_id stay."""
    gone = near_duplicates(docs, threshold).filter("NOT kept").select("doc_id").distinct()
    gone = materialize(gone, "near-copies")
    gone = F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


# Every pair, not only those that share a band: equal unless MinHash misses a link.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS shingle FROM d WHERE len(w) > 0),
cells AS (SELECT doc_id, shingle, row_number() OVER (PARTITION BY doc_id, shingle) AS nth FROM s),
weights AS (SELECT doc_id, count(*) AS n FROM cells GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM cells a JOIN cells b ON a.shingle = b.shingle AND a.nth = b.nth AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM met JOIN weights u ON u.doc_id = x JOIN weights v ON v.doc_id = y WHERE met.n >= 0.8 * (u.n + v.n - met.n) - 1e-9),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(y, doc_id)) AS class_id, doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM documents LEFT JOIN least ON doc_id = x
"""
