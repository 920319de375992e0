"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample turns vectors into balanced binary codes. The
code is cut into words of `width` bits; each word is the key of one hash table, and
vectors that share a word (and a label) are compared with their original components
in double precision. Further rotations give further tables until pairs at the
threshold, made from the sample, share no word in at most a share `miss` of cases.

A pair that meets in several tables counts in the first of them only, so links are
counted without listing pairs: each task adds up a vector's links in its block and
emits one spanning forest of them. Buckets are made from words alone; a vector's
components are fetched once for each block that it is compared in.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import hash_sample, join_by_group, materialize, prepare, release
from tidemill.llm.components import connected_components, forest

BLOCK = 1024  # vectors of one bucket that are compared at once
SLOT_ROWS = 4096  # rows that a task's group of small buckets has on average
MODELS = 16  # vector lengths that get learned codes; others get random ones
LEAST_SAMPLE = 256  # rows that codes can be learned from and measured on
MOST_TABLES = 96


def unit_rows(values: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """(usable, unit vector or None) of each row; unusable are null, empty and zero
    vectors and those with a null or non-finite component."""
    out: list[np.ndarray | None] = []
    for row in values:
        x = row.values
        v = None
        if x is not None and len(x) and not x.null_count:
            v = x.to_numpy(zero_copy_only=False).astype(np.float64)
            scale = np.abs(v).max() if np.isfinite(v).all() else 0.0
            v = v / scale if scale > 0 else None
            v = v / math.sqrt(float(v @ v)) + 0.0 if v is not None else None
        out.append(v)
    return np.array([v is not None for v in out], bool), out


def learn_rotations(sample: np.ndarray, count: int, rounds: int = 30) -> np.ndarray:
    """(count, dim, bits) projections: principal directions of the sample, rotated so
    that rounding to signs loses least; each rotation starts from another random one."""
    dim = sample.shape[1]
    bits = min(64, dim)
    centred = sample - sample.mean(0)
    _, _, vt = np.linalg.svd(centred.T @ centred)
    axes = vt[:bits].T
    v = centred @ axes
    out = []
    for k in range(count):
        r = np.linalg.qr(np.random.default_rng(k).standard_normal((bits, bits)))[0]
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        out.append(axes @ r)
    return np.stack(out)


def unit_matrix(raw: list, kind: np.dtype) -> np.ndarray:
    """The unit vectors of usable vectors of one length, given as bytes."""
    v = np.stack([np.frombuffer(x, kind) for x in raw]).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def tables_needed(agree: float, miss: float) -> int:
    """Tables until a pair that shares a word with this probability shares none of them
    with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - agree)) if 0 < agree < 1 else 1 if agree else MOST_TABLES + 1


def word_width(rows: int, bits: int) -> int:
    """Wide enough that a bucket of so many rows has some hundreds of them."""
    return int(min(24, bits, max(8, math.log2(max(1, rows) / 512))))


def at_threshold(sample: np.ndarray, threshold: float, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors whose cosine is the threshold: vectors of the sample, each
    with a neighbour in a random direction."""
    v = sample[:most]
    w = np.random.default_rng(0).standard_normal(v.shape)
    w -= (w * v).sum(1, keepdims=True) * v
    w /= np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-300)
    return v, threshold * v + math.sqrt(max(0.0, 1 - threshold * threshold)) * w


def learn_codes(sample: np.ndarray, rows: int, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(centre, projections, width, words a rotation). Whether words agree is measured on
    pairs at the threshold, from the half of the sample that the codes don't know, because it depends on how the vectors lie around their centre:
    in a narrow cone, signs flip more often. Words get narrower where MOST_TABLES would
    not do, and rotations are added until the measured misses are rare enough."""
    near = at_threshold(sample[1::2] if len(sample) > 1 else sample, threshold)
    sample = sample[::2]
    centre, bits = sample.mean(0), min(64, sample.shape[1])
    first = learn_rotations(sample, 1)
    for width in range(word_width(rows, bits), 0, -1):
        per = max(1, bits // width)
        a, b = (words_of(x, centre, first, width, per) for x in near)
        needed = tables_needed(float((a == b).mean()), miss)
        if needed <= MOST_TABLES:
            break
    rotations = -(-needed // per)
    projections = learn_rotations(sample, rotations)
    while True:
        a, b = (words_of(x, centre, projections, width, per) for x in near)
        if float((a != b).all(1).mean()) <= miss or len(projections) * per >= 2 * MOST_TABLES:
            return centre, projections, width, per
        projections = learn_rotations(sample, len(projections) + 1)


def random_codes(dim: int, rows: int, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Codes by random hyperplanes through the origin, for lengths with too few vectors to
    learn from, and where very many lengths occur: a bit flips with a probability of the angle over pi."""
    width = word_width(rows, 64)
    needed = tables_needed((1 - math.acos(threshold) / math.pi) ** width, miss)
    per = max(1, 64 // width)
    return np.zeros(dim), np.random.default_rng(dim).standard_normal((-(-needed // per), dim, 64)), width, per


def words_of(vectors: np.ndarray, centre: np.ndarray, projections: np.ndarray, width: int, per: int) -> np.ndarray:
    """(rows, tables) integer words of the vectors' codes."""
    powers = 1 << np.arange(width, dtype=np.int64)
    found = []
    for p in projections:
        code = ((vectors - centre) @ p >= 0)[:, : per * width]
        found.append(code.reshape(len(vectors), per, width) @ powers)
    return np.concatenate(found, 1)


def block_links(words_a, vec_a, words_b, vec_b, table: int, threshold: float) -> np.ndarray:
    """Which pairs of two blocks link and meet in this table first."""
    hit = vec_a @ vec_b.T >= threshold
    if hit.any() and table:
        i, j = np.nonzero(hit)
        before = (words_a[i, :table] == words_b[j, :table]).any(1)
        hit[i[before], j[before]] = False
    return hit


def near_embeddings(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = 20_000, miss: float = 0.002) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors.

    Rows link when their labels are equal and not null and their cosine is at least
    the threshold. Null, empty and zero vectors, and those with a null or non-finite
    component, link with nothing and are kept; so is a null vec_id's row, with a null
    component. Vectors of different lengths don't link; vectors of any length are
    indexed. Equal vectors are compared once and link with each other. Each row is a
    vector: rows that share a vec_id count and link as their own vectors say. Other
    columns are ignored; an empty table gives an empty result. The codes are learned
    on the sample_rows rows with the smallest hash; every row is indexed.
    """
    spark = prepare(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)
    names = ["vec_id", "label", "dim", "digest", "vector"]

    def units(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = batch.column("embedding")
            usable, rows = unit_rows(raw)
            usable &= np.array([x is not None for x in batch.column("label").to_pylist()], bool)
            usable &= np.array([x is not None for x in batch.column("vec_id").to_pylist()], bool)
            digests = [hashlib.blake2b(v.tobytes(), digest_size=16).hexdigest() if ok else None for ok, v in zip(usable, rows, strict=True)]
            plain = [raw[k].values.to_numpy(zero_copy_only=False).astype(kind).tobytes() if ok else None for k, ok in enumerate(usable)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([len(v) if ok else 0 for ok, v in zip(usable, rows, strict=True)], pa.int32()), pa.array(digests, pa.string()), pa.array(plain, pa.binary())], names)

    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    rows = materialize(slim.mapInArrow(units, "vec_id long, label string, dim int, digest string, vector binary"), "units")
    total = rows.count()
    # equal vectors are one class; its node number is unique even where ids repeat
    classes = rows.filter("digest IS NOT NULL").groupBy("label", "digest").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links = _links(spark, classes, kind, threshold, sample_rows, miss)
    roots = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
    nodes = materialize(nodes.join(classes.select("node", "class_id"), "node"), "nodes")
    least = nodes.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("n"))
    named = join_by_group(nodes.select("node", "component"), least, ["component"], "n", total).select("node", "component_id")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = classes.drop("vector", "dim").join(counts, "node", "left").join(named, "node", "left")
    found = found.select("label", "digest", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    members = join_by_group(rows.filter("digest IS NOT NULL").select("vec_id", "label", "digest"), found, ["label", "digest"], "copies", total)
    alone = rows.filter("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(spark: SparkSession, classes: DataFrame, kind: np.dtype, threshold: float, sample_rows: int, miss: float) -> DataFrame:
    """A table of node, links and root: how many vectors each class links with in a task,
    and its root in the task's spanning forest."""
    dims = [r["dim"] for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MODELS).collect()]
    busiest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    models = {}
    for dim in dims:  # an embedding table has one dimension; strays get codes of their own
        found = hash_sample(classes.filter(F.col("dim") == dim).select("class_id", "node", "vector"), ["class_id", "node"], sample_rows).select("vector").toArrow()
        if len(found) < LEAST_SAMPLE:
            models[dim] = random_codes(dim, busiest, threshold, miss)
            continue
        models[dim] = learn_codes(unit_matrix(found["vector"].to_pylist(), kind), busiest, threshold, miss)
    shared = spark.sparkContext.broadcast(models)  # some rotations of 64 directions

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per class: its words, one for each table."""
        models = dict(shared.value)
        for batch in it:
            dims = batch.column("dim").to_numpy()
            words: list[list[int]] = [[]] * batch.num_rows
            raw = batch.column("vector").to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                model = models.get(int(dim)) or random_codes(int(dim), busiest, threshold, miss)
                for k, w in zip(at, words_of(unit_matrix([raw[k] for k in at], kind), *model).tolist(), strict=True):
                    words[k] = w
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "dim")), pa.array(words, pa.list_(pa.int64()))], ["node", "label", "dim", "words"])

    indexed = classes.select("node", "label", "dim", "vector").mapInArrow(index, "node long, label string, dim int, words array<long>")
    indexed = materialize(indexed, "codes")
    n = indexed.count()
    entries = indexed.select("node", "label", "dim", F.posexplode("words").alias("table", "word"))
    # buckets of more than BLOCK rows are cut into blocks, and pairs of blocks are dealt out
    sizes = entries.groupBy("label", "dim", "table", "word").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    entries = join_by_group(entries, sizes, ["label", "dim", "table", "word"], "n", max(1, n))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    entries = entries.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    slots = max(1, -(-n // SLOT_ROWS))
    # a slot holds many small buckets, or one pair of blocks of a large one
    small = F.pmod(F.xxhash64("label", "dim", "word"), F.lit(slots))
    slot = F.when(F.col("blocks") == 1, small).otherwise(F.xxhash64("label", "dim", "word", "low", "high"))
    bucket = F.xxhash64("label", "dim", "word", "low", "high")
    entries = entries.select("table", slot.alias("slot"), bucket.alias("bucket"), "dim", "word", (F.col("block") == F.col("low")).alias("in_low"), (F.col("block") == F.col("high")).alias("in_high"), "node")
    entries = entries.join(classes.select("node", "label", "copies", "vector"), "node").join(indexed.select("node", "words"), "node")

    def compare(group: pa.Table) -> pa.Table:
        table = group["table"][0].as_py()
        frame = group.drop_columns(["vector", "words"]).to_pandas()
        ids, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        vectors, words = group["vector"].combine_chunks(), group["words"].combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in frame.groupby(["label", "dim", "word", "bucket"], sort=False).indices.values():
            if len(at) < 2:
                continue
            vec = unit_matrix([vectors[int(k)].as_py() for k in at], kind)
            own = np.array([words[int(k)].as_py() for k in at], np.int64)
            a, b = (np.flatnonzero(frame[c].to_numpy()[at]) for c in ("in_low", "in_high"))
            hit = block_links(own[a], vec[a], own[b], vec[b], table, threshold)
            one_block = len(a) == len(b) and (a == b).all()
            if one_block:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            i, j = np.nonzero(hit)
            ia, ib = at[a[i]], at[b[j]]
            nodes, roots = forest(ids[ia], ids[ib])
            sums = np.zeros(len(nodes), np.int64)
            np.add.at(sums, np.searchsorted(nodes, ids[ia]), copies[ib])
            if not one_block:
                np.add.at(sums, np.searchsorted(nodes, ids[ib]), copies[ia])
            out.append((nodes, sums, roots))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"node": columns[0], "links": columns[1], "root": columns[2]})

    found = materialize(entries.groupBy("table", "slot").applyInArrow(compare, "node long, links long, root long"), "links")
    release(indexed)
    return found


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.x LEFT JOIN counted ON vec_id = counted.x
"""
