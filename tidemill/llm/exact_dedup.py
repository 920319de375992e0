"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Pass one hashes each digest to a position of a sparse counting filter and counts the
hits (partial counts are combined before the shuffle, one row per text and task). The
positions hit twice or more become a blocked Bloom filter, stored in Spark's bitmaps,
whose size follows their number: it is small where most texts occur once. Pass two
probes it: a text that the filter doesn't hold occurs once and its row passes straight
through; only the others are shuffled and grouped by digest. `max_bits` bounds what is
broadcast; with more repeated texts than fit, the filter lets more rows into the
shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import documents, join_by_group, materialize, release

HASHES = 3
BLOCK = 32768  # bits in one bitmap of Spark's bitmap functions
SPACE = 1 << 48  # positions of the counting filter
MAX_BITS = 1 << 30
SMALL_GROUPS = 1 << 18  # groups whose digests and ids may be broadcast


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _position(digest: str) -> Column:
    return F.pmod(F.xxhash64(F.col(digest)), F.lit(SPACE))


def _bit(k: int) -> Column:
    return F.pmod(F.xxhash64(F.col("p"), F.lit(k)), F.lit(BLOCK)).cast("int")


def repeated_filter(digests: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """(block, bitmap) of a filter that holds the digests which at least two rows have,
    and its number of blocks."""
    hits = digests.select(_position("text_sha256").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    twice = materialize(hits.filter("n > 1").select("p"), "twice")
    blocks = max(1, min(max_bits, 16 * twice.count()) // BLOCK + 1)
    bits = twice.select(F.pmod(F.col("p"), F.lit(blocks)).alias("block"), F.explode(F.array(*(_bit(k) for k in range(HASHES)))).alias("bit"))
    found = materialize(bits.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bitmap")), "filter")
    release(twice)
    return found, blocks


def probe(rows: DataFrame, found: DataFrame, blocks: int) -> DataFrame:
    """rows with `maybe`: whether the filter holds their text_sha256."""
    names = rows.columns
    rows = rows.withColumn("p", _position("text_sha256")).withColumn("block", F.pmod(F.col("p"), F.lit(blocks)))
    rows = rows.join(F.broadcast(found), "block", "left")
    hits = []
    for k in range(HASHES):
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(_bit(k) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hits.append(F.call_function("shiftright", byte, _bit(k) % 8).bitwiseAND(F.lit(1)) == 1)
    return rows.select(*names, F.coalesce(hits[0] & hits[1] & hits[2], F.lit(False)).alias("maybe"))


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("text_sha256"))


def mark_exact_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs.

    Texts are equal when identical as they are; null counts as empty, so null and
    empty texts are copies of each other. The largest doc_id of a group is kept.
    Rows repeated with id and text are the same document: each counts in group_size
    and all carry the same flag. A null doc_id is kept only where a group has no
    other. Texts of any length count whole; only digests are moved. Other columns are
    ignored; an empty table gives an empty result.
    """
    digests = materialize(_digests(docs), "digests")
    found, blocks = repeated_filter(digests, max_bits)
    probed = probe(digests, found, blocks)
    once = probed.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    several = materialize(probed.filter("maybe").drop("maybe"), "several")
    groups = several.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    marked = join_by_group(several, groups, ["text_sha256"], "group_size", several.count())
    return once.unionByName(marked.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_exact_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest doc_id;
    all columns stay, whatever their names.

    Null and empty texts, null ids, empty tables and long texts count as in
    mark_exact_copies. Of rows repeated with id and text one stays, the same in every
    run where their other columns differ (the one whose columns hash smallest). Rows of
    texts that occur once are not shuffled; of the others only those that stay are, once.
    """
    digests = materialize(_digests(docs), "digests")
    found, blocks = repeated_filter(digests, max_bits)
    several = probe(digests, found, blocks).filter("maybe")
    stays = materialize(several.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id")), "stays")
    release(digests)
    # the row travels as one column that cannot clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = probe(rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), _digest(F.col("row.text")).alias("text_sha256")), found, blocks)
    chosen = F.broadcast(stays) if stays.count() <= SMALL_GROUPS else stays
    again = rows.filter("maybe").join(chosen, (rows["text_sha256"] == stays["text_sha256"]) & rows["doc_id"].eqNullSafe(stays["keep_id"]), "left_semi")
    others = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if f.name != "text" and isinstance(f.dataType, T.AtomicType)]
    again = again.groupBy("doc_id", "text_sha256").agg(F.min_by("row", F.xxhash64(*others)).alias("row"))
    return rows.filter(~F.col("maybe")).select("row").unionByName(again.select("row")).select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_copies(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
