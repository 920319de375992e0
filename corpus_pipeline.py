"""The training-data pipeline: documents in, packed token sequences out.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and
returns a DataFrame; run() writes each result as Parquet in the shared folder and
rereads it as the next stage's docs, so a lost executor never costs more than the
stage that is running. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import exact_dedup, language_crf, minhash_dedup, packing, suffix_dedup
from tidemill.llm.common import documents, materialize, release_since, written

# No stage but the second can be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the predicted language; documents without a letter (null and empty
    texts too), or whose best language has a mean posterior under 0.3, go. The model is
    learned from docs; where they have no lang, every document goes. Rows are judged one
    by one, so repeated rows and null ids count like others; long texts are read whole;
    other columns stay; an empty table gives an empty result."""
    return language_crf.keep_identified(docs, language_crf.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; null counts as empty, and a
    row with a null id stays only where no other has the text. Of rows that repeat id
    and text one stays. All columns stay, whatever their names; texts of any length
    count whole; an empty table gives an empty result."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Texts
    without a word (null and empty ones too) and rows with a null id stay; all rows of an
    id stay or go together. All columns stay, whatever their names; long texts are
    compared whole; an empty table gives an empty result."""
    return minhash_dedup.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 50 bytes or more that a document with a smaller id has as well;
    n_chars follows. Rows without a text or an id stay as they are, and rows that share
    an id lose nothing to each other. All columns stay, whatever their names; long texts
    are read whole; an empty table gives an empty result."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece, with its token ids. Null and empty texts give one piece
    with the end id alone; repeated rows are packed each; a null id stays null; other
    columns are ignored; long texts are packed whole; an empty table gives an empty
    result."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir. Once a stage's result is written, all
    tables that it was made from are deleted."""
    docs, mark = documents(spark, sf_dir), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
