import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_dedup import _brute_near, _brute_repeats, _family, _near, _passages
from tidemill.llm import packing
from tidemill.llm.common import documents, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_their_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    assert entry_point.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in entry_point.queries() if q.startswith("op")}


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """A small corpus with planted copies, and every stage's result."""
    import random

    rng = random.Random(0)
    vocabulary = {"en": ["the", "thing", "er", "ation", "and", "with"], "de": ["schz", "ung", "keit", "der", "pf", "ver"]}
    make = lambda lang, n: " ".join("".join(rng.choice(vocabulary[lang]) for _ in range(2)) for _ in range(n))
    rows = [(k, make(lang, 60), lang) for k, lang in enumerate(["en", "de"] * 30)]
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(6)]  # exact copies
    rows += [(200 + k, _near(rows[10 + k][1], 1, k), rows[10 + k][2]) for k in range(6)]  # near copies
    rows += [(300 + k, make("en", 20) + " " + rows[20][1][:150] + " " + make("en", 30), "en") for k in range(4)]  # a shared passage
    rows += [(400, "123 !!", "en"), (401, None, "en"), (402, "", None)]
    folder = f"file://{tmp_path_factory.mktemp('pipeline')}"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    df.write.parquet(f"{folder}/documents.parquet")
    found, docs = [], documents(spark, folder)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        found.append((name, docs))
    return folder, rows, dict(found)


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_each_stage_equals_brute_force(staged):
    _, rows, stages = staged
    one = _texts(stages["language_id"])
    assert set(one) == {d for d, t, _ in rows if t and any(c.isalpha() for c in t)}
    two = _texts(stages["exact_dedup"])
    keep = {}
    for d, t in one.items():
        keep[t] = max(d, keep.get(t, d))
    assert set(two) == set(keep.values())
    three = _texts(stages["near_dedup"])
    assert set(three) == set(_brute_near(sorted(two.items())).values()) and len(three) < len(two)
    four = _texts(stages["suffix_dedup"])
    removed = {d: n for d, _, n, _, _ in _brute_repeats([(d, t.encode()) for d, t in three.items()])}
    assert {d: len(three[d].encode()) - len(t.encode()) for d, t in four.items()} == removed and sum(removed.values()) > 0
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces: dict = {}
    for r in sorted(stages["packing"].collect(), key=lambda r: r["start"]):
        pieces.setdefault(r["doc_id"], []).extend(r["ids"])
    assert pieces == {d: [*lib.encode(t, add_special_tokens=False).ids, packing.END_ID] for d, t in four.items()}


def test_one_document_of_a_large_family_stays(spark, docs):
    """Different near copies, without the text that they come from."""
    rows = _family(500, 5, 3)
    kept = corpus_pipeline.drop_near_copies(spark, docs(rows), "")
    assert {r["doc_id"] for r in kept.collect()} == set(_brute_near(rows).values())


def test_all_but_the_last_stage_return_documents(staged):
    _, _, stages = staged
    for name, df in list(stages.items())[:-1]:
        assert df.columns == COLUMNS, name
        assert all(r["n_chars"] == len(r["text"]) for r in df.collect())


def test_run_equals_the_stages(spark, staged):
    folder, _, stages = staged
    key = lambda df: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(stages["packing"])


def test_run_on_a_test_table(spark):
    out = corpus_pipeline.run(spark, SF).select("doc_id", "length").collect()
    assert len({r["doc_id"] for r in out}) > 150 and np.all([r["length"] <= packing.CAP for r in out])


def test_passages_fixture_is_not_trivial():
    assert sum(r[2] for r in _brute_repeats(_passages(0))) > 0
