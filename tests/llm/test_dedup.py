import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SF, by_id
from tidemill.llm import components, exact_dedup, minhash_dedup, suffix_dedup
from tidemill.llm.common import documents, join_by_group, materialize

# exact copies


def test_exact_dedup_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(exact_dedup.ORACLE)
    got = exact_dedup.op3_exact_dedup(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_exact_dedup_of_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, "b"), (None, "c"), (None, "a")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.mark_exact_copies(docs(rows)).collect()), key=repr)
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (5, 5, 1, True), (None, None, 1, True), (None, 4, 4, False)], key=repr)
    kept = exact_dedup.drop_exact_copies(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(2, ""), (4, "a"), (5, "b"), (None, "c")], key=repr)
    assert exact_dedup.mark_exact_copies(docs([])).count() == exact_dedup.drop_exact_copies(docs([])).count() == 0


def test_a_small_filter_changes_nothing(docs):
    rows = [(k, f"text {k % 400}") for k in range(500)]
    for bits in (1, exact_dedup.BLOCK, 1 << 20):
        out = by_id(exact_dedup.mark_exact_copies(docs(rows), max_bits=bits))
        assert sum(r["kept"] for r in out.values()) == 400 and out[3]["keep_id"] == 403 and out[300]["group_size"] == 1


@pytest.mark.parametrize("max_bits", [1, exact_dedup.MAX_BITS])
def test_filter_finds_every_repeat(spark, docs, max_bits):
    digests = materialize(exact_dedup._digests(docs([(k, f"t{k % 700}") for k in range(1000)])), "digests")
    probed = exact_dedup.probe(digests, *exact_dedup.repeated_filter(digests, max_bits))
    repeated = digests.groupBy("text_sha256").count().filter("count > 1")
    assert probed.filter("NOT maybe").join(repeated, "text_sha256").count() == 0
    assert probed.filter("maybe").count() < 700


def test_exact_copies_of_rows_with_internal_names(spark):
    """Columns named like the operator's own change nothing and stay; of rows that repeat
    id and text the same one stays in every partitioning."""
    names = ["text_sha256", "maybe", "p", "block", "bitmap", "row", "keep_id", "_keep", "_map0", "a.b"]
    rows = [(k, f"t{k % 5}" * 9, *([f"{k}"] * len(names))) for k in range(12)] + [(11, "t1" * 9, *(["other"] * len(names)))]
    table = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = [sorted(map(tuple, exact_dedup.drop_exact_copies(table.repartition(n)).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and exact_dedup.drop_exact_copies(table).columns == table.columns
    assert [r[0] for r in kept[0]] == [7, 8, 9, 10, 11] and all(r in rows for r in kept[0])
    assert exact_dedup.mark_exact_copies(table).count() == 13


def test_exact_copies_of_very_long_texts(docs):
    text = "long text " * 400_000
    got = by_id(exact_dedup.mark_exact_copies(docs([(1, text), (2, text), (3, text + "x")])))
    assert [(got[k]["keep_id"], got[k]["kept"]) for k in (1, 2, 3)] == [(2, False), (2, True), (3, True)]


def test_hot_groups_are_broadcast(spark):
    rows = spark.range(1000).select((F.when(F.col("id") < 600, 0).otherwise(F.col("id"))).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_by_group(rows, groups, ["k"], "n", 1000)
    assert joined.count() == 1000 and joined.filter("n = 600").count() == 600


# components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_forest(edges):
    nodes, roots = components.forest(*(np.array(x, np.int64) for x in zip(*edges, strict=True)))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == _brute_components(edges)


def _brute_components(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("edges_per_task", [3, 1_000_000])
def test_connected_components(spark, edges_per_task):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 120)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, k) for k in range(200, 260)] + [(9, 9)]
    table = materialize(spark.createDataFrame(edges, "a long, b long"), "edges")
    found = {r["node"]: r["component"] for r in components.connected_components(table, edges_per_task).collect()}
    assert found == {k: v for k, v in _brute_components(edges).items() if k != v}
    assert components.connected_components(table.limit(0)).count() == 0


# near copies


def _near(base, edits, seed):
    rng, words = random.Random(seed), base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def _brute_near(rows, threshold=0.8):
    rows = [(i, t or "") for i, t in rows]
    owner, cell = minhash_dedup.cells([t for _, t in rows])
    sets = [set(cell[owner == k].tolist()) for k in range(len(rows))]
    edges = [(i, i) for i, _ in rows]
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and both >= threshold * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                edges.append((rows[y][0], rows[x][0]))
    return _brute_components(edges)


def test_cells_are_shingles_with_their_counts():
    def slow(text):
        import re

        words = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", text.lower())
        return [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []

    for a, b in (("a b c d e f a b c d e", "A, b. c! d\ne f"), ("été one two", "ÉTÉ ONE TWO"), ("x", "x y"), ("", "!?"), ("a b c d e", "a b c d e a b c d e")):
        owner, cell = minhash_dedup.cells([a, b])
        assert [int((owner == k).sum()) for k in (0, 1)] == [len(slow(a)), len(slow(b))]
        from collections import Counter

        ca, cb = Counter(slow(a)), Counter(slow(b))
        assert len(set(cell[owner == 0]) & set(cell[owner == 1])) == sum((ca & cb).values())


def test_signatures_estimate_similarity():
    rng, errors = random.Random(2), []
    for k in range(40):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 200, 1500])))
        owner, cell = minhash_dedup.cells([base, _near(base, 4, k)])
        a, b = set(cell[owner == 0].tolist()), set(cell[owner == 1].tolist())
        s = minhash_dedup.signatures(owner, cell, 2)
        assert (s != 0).all()
        errors.append(float((s[0] == s[1]).mean()) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_near_duplicates_equal_brute_force(docs):
    rng = random.Random(1)
    vocabulary = [f"word{k}" for k in range(800)]
    bases = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([40, 120, 400]))) for _ in range(30)]
    rows = list(enumerate(bases))
    for k, b in enumerate(bases):
        for copy in range(rng.randrange(4)):
            rows.append((100 + 10 * k + copy, _near(b, rng.choice([0, 1, 2, 6, 20]), 10 * k + copy)))
    rows += [(900 + k, _near(bases[0], 1, 900 + k)) for k in range(40)]
    want = _brute_near(rows)
    got = by_id(minhash_dedup.near_duplicates(docs(rows)))
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    kept = minhash_dedup.drop_near_duplicates(docs(rows))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and kept.columns == docs(rows).columns


def test_a_crowd_that_only_resembles_one_text(docs):
    """Copies that are each close to the original but not to each other, in buckets too
    large to compare pair by pair."""
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    rows = [(k, _near(base, 5, k)) for k in range(160)] + [(1000, base)]
    want = _brute_near(rows)
    assert len(set(want.values())) == 1
    got = {i: r["class_id"] for i, r in by_id(minhash_dedup.near_duplicates(docs(rows))).items()}
    assert got == want


def _family(n, edits, seed):
    """n different near copies of a text of 300 words, without the text itself."""
    rng = random.Random(seed)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    return [(k, _near(base, edits, 1000 * seed + k)) for k in range(n)]


def test_a_large_family_without_its_original(docs):
    """Links of large buckets that avoid the texts all others are compared with first."""
    rows = _family(500, 5, 3)
    want = _brute_near(rows)
    assert {i: r["class_id"] for i, r in by_id(minhash_dedup.near_duplicates(docs(rows))).items()} == want


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 40}, {"BLOCK_CELLS": 5000}])
def test_components_that_meet_in_a_large_bucket_are_joined(docs, limits, monkeypatch):
    """Several found components, each with links, of one class; also with buckets cut into blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(minhash_dedup, name, value)
    rows = _family(400, 4, 5)
    want = _brute_near(rows)
    assert {i: r["class_id"] for i, r in by_id(minhash_dedup.near_duplicates(docs(rows))).items()} == want


@pytest.mark.parametrize("start", ["apart", "halves"])
def test_joining_links_join_what_all_links_join(start):
    owner, cell = minhash_dedup.cells([t for _, t in _family(60, 5, 7) + _family(20, 30, 8) + _family(30, 1, 9)] + ["one two three"] * 2)
    sets = [np.sort(cell[owner == k]) for k in range(112)]
    component = np.arange(112) if start == "apart" else np.arange(112) % 40
    both = lambda x, y: len(set(sets[x].tolist()) & set(sets[y].tolist()))
    links = [(x, y) for x in range(112) for y in range(x) if both(x, y) >= 0.8 * (len(sets[x]) + len(sets[y]) - both(x, y)) - 1e-9]
    found = minhash_dedup.joining_links(sets, component, 0.8)
    assert {(max(x), min(x)) for x in found} <= set(links)
    known = [(k, int(np.flatnonzero(component == c)[0])) for k, c in enumerate(component)]
    assert _brute_components(known + found) == _brute_components(known + links)


def _template(n, fixed, own, seed):
    """n texts that share `fixed` words of one template; pairs share `own` further ones."""
    rng = random.Random(seed)
    head = [f"t{k}" for k in range(fixed)]
    rows = []
    for k in range(n):
        pair = random.Random(seed * 1000 + k // 2)
        rows.append((k, " ".join(head + [f"p{pair.randrange(10**9)}" for _ in range(own)] + [f"x{rng.randrange(10**9)}" for _ in range(27 - own)])))
    return rows


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 60}])
def test_every_link_of_a_template_family_is_found(docs, limits, monkeypatch):
    """Hundreds of texts of one template: strangers stay just under the threshold and meet
    in crowded buckets, each text has one partner just over it."""
    for name, value in limits.items():
        monkeypatch.setattr(minhash_dedup, name, value)
    rows = _template(400, 204, 3, 4)
    want = _brute_near(rows)
    assert len(set(want.values())) == 200
    assert {i: r["class_id"] for i, r in by_id(minhash_dedup.near_duplicates(docs(rows))).items()} == want


def test_near_duplicates_of_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "one two"), (5, "One, two."), (6, "one two three"), (7, "same row " * 9), (7, "same row " * 9), (None, "one two")]
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs(rows)).collect()), key=repr)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True), (7, 7, True), (None, None, True)], key=repr)
    assert minhash_dedup.near_duplicates(docs([])).count() == minhash_dedup.drop_near_duplicates(docs([])).count() == 0


def test_rows_that_share_an_id_are_one_document(docs):
    a, b, c = (t for _, t in _family(1, 0, 1) + _family(1, 0, 2) + _family(1, 0, 3))
    rows = [(1, a), (2, b), (3, a), (3, b), (3, None), (4, _near(b, 1, 1)), (5, c), (5, c), (6, _near(c, 1, 2))]
    got = sorted((r["doc_id"], r["class_id"]) for r in minhash_dedup.near_duplicates(docs(rows)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 1), (3, 1), (4, 1), (5, 5), (5, 5), (6, 5)]
    assert sorted(r["doc_id"] for r in minhash_dedup.drop_near_duplicates(docs(rows)).collect()) == [1, 5, 5]


def test_near_copies_of_a_very_long_text(docs):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    got = by_id(minhash_dedup.near_duplicates(docs([(1, text), (2, text + " more"), (3, text[: len(text) // 2])])))
    assert [got[k]["class_id"] for k in (1, 2, 3)] == [1, 1, 3]


def test_near_duplicate_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    assert {i: r["class_id"] for i, r in by_id(minhash_dedup.op5_minhash_dedup(spark, SF)).items()} == _brute_near(rows)


# repeated passages


def _brute_repeats(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < d:
                gone[k : k + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def _passages(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "a", "the", "of", "ab"]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    rows = []
    for d in range(80):
        text = ""
        for _ in range(rng.randrange(6)):
            kind = rng.random()
            if kind < 0.5:
                b = rng.choice(base)
                k = rng.randrange(len(b))
                text += b[k : k + rng.randrange(30, 200)]
            else:
                text += "a" * rng.randrange(200) if kind < 0.7 else "ab" * rng.randrange(90) if kind < 0.85 else "".join(rng.choice("abcdé ") for _ in range(60))
        rows.append((d, text.encode()))
    line = b"This work is licensed under the common public licence, version 2.0 or later."
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(60)).encode()
    return rows + [(200 + k, noise() + line + noise()) for k in range(120)]


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 1500, "bucket_bytes": 2500}])
def test_repeats_equal_brute_force(docs, options):
    rows = _passages(len(options))
    got = suffix_dedup.mark_repeats(docs([(d, t.decode()) for d, t in rows]), **options)
    assert sorted(map(tuple, got.collect())) == _brute_repeats(rows)


def test_repeats_of_odd_rows(docs):
    passage = "A passage of more than fifty bytes, which several documents share. "
    rows = [(1, None), (2, ""), (3, "short"), (4, passage), (4, passage + "x"), (5, "é" + passage), (None, passage), (0, passage[:49])]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.mark_repeats(docs(rows)).collect()), key=repr)
    n = len(passage)
    assert got == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 0, 0), (4, n, 0, 0), (4, n + 1, 0, 0), (5, n + 2, n, 1), (None, n, 0, 0), (0, 49, 0, 0)], key=repr)
    cut = suffix_dedup.remove_repeats(docs(rows))
    assert cut.columns == docs(rows).columns
    assert sorted((r["text"] for r in cut.filter("doc_id = 5 OR doc_id = 4").collect())) == sorted([passage, passage + "x", "é"])
    assert cut.filter("doc_id = 5").first()["n_chars"] == 1 and cut.count() == len(rows)
    assert suffix_dedup.mark_repeats(docs([])).count() == suffix_dedup.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("rows", [[(1, "a"), (2, "a"), (3, "b")], [(1, ""), (2, "")], [(1, None)], [(None, "x")], [(None, None), (None, "y" * 99)], [(4, "z" * 80)] * 3])
def test_repeats_of_tables_of_one_kind(docs, rows):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.mark_repeats(docs(rows)).collect()), key=repr)
    assert got == sorted([(d, len(t or ""), 0, 0) for d, t in rows], key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in suffix_dedup.remove_repeats(docs(rows)).collect()), key=repr) == sorted(rows, key=repr)


def _removed_in_process(rows, chunks):
    """(doc_id, text, bytes removed) of rows dealt into chunks, with all steps in this
    process, so that patched limits hold for all of them."""
    dealt = [suffix_dedup.Chunk.of(__import__("pyarrow").table({"doc_id": [d for d, _ in part], "text": [t.decode() for _, t in part]})) for part in (rows[k::chunks] for k in range(chunks))]
    packed = [next((e for _, e in c.entries(1)), np.zeros(0, np.uint8)) for c in dealt]
    code = suffix_dedup.judge_segments(*(np.concatenate(x) for x in zip(*map(suffix_dedup._unpack, packed), strict=True)))
    codes = np.split(code, np.cumsum([len(e) // suffix_dedup._ENTRY for e in packed])[:-1])
    sent = {}  # bucket -> (chunk, marks, documents, windows, bytes)
    for k, (c, code) in enumerate(zip(dealt, codes, strict=True)):
        for b, mark, row, start, count in c.candidates(code, 1):
            raw = b"".join(c.texts[r][s : s + n + 49] for r, s, n in zip(row, start, count, strict=True))
            sent.setdefault(b, []).append((k, mark, c.ids[row], count, np.frombuffer(raw, np.uint8)))
    flags = [{} for _ in dealt]
    for b, found in sent.items():
        marks, docs, windows, raw = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
        parts = np.split(suffix_dedup.repeated_windows(marks, docs, windows, raw), np.cumsum([int(f[3].sum()) for f in found])[:-1])
        for f, part in zip(found, parts, strict=True):
            flags[f[0]][b] = part
    out = []
    for c, code, flag in zip(dealt, codes, flags, strict=True):
        out += [(int(d), t, int(suffix_dedup.removed_bytes(len(t), s).sum())) for d, t, s in zip(c.ids, c.texts, c.repeats(code, flag, 1), strict=True)]
    return sorted(out), codes


def _want_removed(rows):
    return sorted((d, t, r[2]) for (d, t), r in zip(sorted(rows, key=lambda x: x[0]), sorted(_brute_repeats(rows), key=lambda x: x[0]), strict=True))


@pytest.mark.parametrize("limits", [{}, {"CROWD": 1}, {"CROWD_ALL": 1}, {"CROWD": 2, "CROWD_ALL": 5}])
@pytest.mark.parametrize("chunks", [1, 7])
def test_crowded_marks(limits, chunks, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = _passages(3)
    got, codes = _removed_in_process(rows, chunks)
    assert got == _want_removed(rows)
    assert any((c == suffix_dedup.SINGLE).any() for c in codes) or not limits


@pytest.mark.parametrize("chunks", [1, 5])
def test_pairs_that_collide_take_the_verified_path(chunks, monkeypatch):
    """With contents that all hash alike, the chunks' byte comparison finds the difference."""
    real = suffix_dedup.segments_of
    monkeypatch.setattr(suffix_dedup, "segments_of", lambda raw: (lambda m, c, s, n: (m % np.uint64(3), np.zeros_like(c), s, n))(*real(raw)))
    rows = _passages(4)[:40]
    got, codes = _removed_in_process(rows, chunks)
    assert got == _want_removed(rows) and all((c == suffix_dedup.SINGLE).all() for c in codes)


def test_one_id_over_all_chunks_loses_nothing_to_itself(docs):
    rows = [(5, t) for _, t in _passages(3)] + [(9, t) for _, t in _passages(3)[:20]]
    got = suffix_dedup.mark_repeats(docs([(d, t.decode()) for d, t in rows]), chunk_bytes=1500, bucket_bytes=2500)
    assert sorted(map(tuple, got.collect())) == _brute_repeats(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.text("ab", min_size=50, max_size=75)), min_size=1, max_size=25))
def test_suffix_sort_groups_equal_windows(texts):
    marks, ids = np.array([m for m, _, _ in texts], np.uint64), np.array([d for _, d, _ in texts], np.int64)
    windows = np.array([len(t) - 49 for _, _, t in texts], np.int64)
    got = suffix_dedup.repeated_windows(marks, ids, windows, np.frombuffer("".join(t for _, _, t in texts).encode(), np.uint8))
    want = []
    for m, d, t in texts:
        for k in range(len(t) - 49):
            want.append(any(m == m2 and d2 < d and t[k : k + 50] in t2 for m2, d2, t2 in texts))
    assert got.tolist() == want


def test_mergesort_orders_suffixes_and_verifies_collisions(monkeypatch):
    rng = random.Random(3)
    raw = np.frombuffer("".join(rng.choice("ab") for _ in range(400)).encode(), np.uint8)
    start = np.arange(350)
    sorter = suffix_dedup.SuffixSort(raw, start)
    order = sorter.sort(np.array(rng.sample(range(350), 350)), np.array([0]), np.array([350]))
    keys = [raw[k : k + 50].tobytes() for k in order]
    assert keys == sorted(keys)
    sorter.whole = np.zeros(350, np.uint64)  # as if all hashes collided
    assert sorter.same(order[1:], order[:-1]).tolist() == [a == b for a, b in zip(keys[1:], keys, strict=False)]
