"""Language identification with a linear-chain conditional random field.

Every word of a text is labelled with a language by forward-backward over emission
scores (affixes, character n-grams, the word itself and the lexicons it is in, hashed)
and learned transitions, so code-switched texts are read span by span. A text's
language is the one with the largest mean posterior over its words. Training texts are
of one language each; texts spliced from pieces of several teach the transitions
between languages.

Long texts are cut into segments that overlap by some words on each side, which bounds
the steps of a batch. Only the inner words of a segment count. Where the posteriors of
two segments differ at their border by more than CLOSE, the text is read again with a
wider overlap, up to the whole chain.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import documents, id_and_text, own_worker, prepare, small_batches, within
from tidemill.llm.quality import held_out

BITS = 17
SEGMENT, OVERLAP, CLOSE = 1024, 32, 1e-4
LEXICON = 400  # words in a language's lexicon
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, with the combining marks between and after them."""
    return _WORD.findall(text.lower())


def _hash(kind: int, *columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(items: list[str], lexicon: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) pairs of all words: bigrams and trigrams with the word's ends
    marked, prefixes and suffixes of one to three characters, the word, and the numbers
    of the lexicons that hold it."""
    chars = np.frombuffer("".join(f"\2{w}\3" for w in items).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in items], np.int64)
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(items)), size)
    owners, found = [], []

    def grams(kind: int, n: int, where: np.ndarray) -> None:
        where = where[where + n <= len(chars)]
        where = where[owner[where] == owner[where + n - 1]]
        owners.append(owner[where])
        found.append(_hash(kind, *(chars[where + k] for k in range(n))))

    everywhere = np.arange(len(chars))
    grams(2, 2, everywhere)
    grams(3, 3, everywhere)
    for n in (1, 2, 3):
        grams(10 + n, n + 1, start)
        grams(20 + n, n + 1, np.maximum(end - n - 1, start))
    # the whole word, as a polynomial of its characters
    place = np.arange(len(chars)) - start[owner]
    powers = np.cumprod(np.full(int(size.max(initial=1)), 0x5851F42D4C957F2D, np.uint64))
    word = np.add.reduceat(chars * powers[place], start) if len(items) else np.zeros(0, np.uint64)
    owners.append(np.arange(len(items)))
    found.append(_hash(1, word))
    if lexicon:
        held = [(k, n) for k, w in enumerate(items) for n in lexicon.get(w, ())]
        owners.append(np.array([k for k, _ in held], np.int64))
        found.append(_hash(30, np.array([n for _, n in held], np.uint64)))
    return np.concatenate(owners), np.concatenate(found)


@dataclass
class Crf:
    labels: list[str]
    emission: np.ndarray  # feature x label
    transition: np.ndarray  # label x label, log scale
    lexicon: dict[str, list[int]] = field(default_factory=dict)  # word -> numbers of the languages it is common in
    held: int = 0
    rows: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def model(self) -> tuple:
        """What a worker needs to build the same one."""
        return self.labels, self.emission, self.transition, self.lexicon

    def scores_of(self, split: list[list[str]], capacity: int = 300_000, characters: int = 16_000_000) -> list[np.ndarray]:
        """For each text the row numbers of its words in self.scores, which starts anew
        when it holds more words or characters than it may."""
        if self.scores is None or len(self.rows) > capacity or self.held > characters:
            self.rows, self.held, self.scores = {}, 0, np.zeros((0, len(self.labels)), np.float32)
        new = list(set().union(*split).difference(self.rows))
        self.held += sum(map(len, new))
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            at = len(self.rows)
            self.rows.update(zip(part, range(at, at + len(part)), strict=True))
            self.scores = np.concatenate([self.scores, emissions(self.emission, *word_features(part, self.lexicon), len(part))])
        get = self.rows.__getitem__
        return [np.fromiter(map(get, s), np.int64, len(s)) for s in split]


def emissions(weights: np.ndarray, owner: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(owner, weights[found, k], n) for k in range(weights.shape[1])]).astype(np.float32)


def segments(lengths: dict[int, int], overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """(text, from, to, first inner, last inner + 1) of all pieces, longest first."""
    out = []
    for k, n in lengths.items():
        for a in range(0, n, SEGMENT):
            b = min(n, a + SEGMENT)
            out.append((k, max(0, a - overlap), min(n, b + overlap), a, b))
    out.sort(key=lambda s: s[1] - s[2])
    return out


def forward_backward(potentials: np.ndarray, lengths: np.ndarray, transition: np.ndarray, counted: np.ndarray | None = None):
    """Posteriors of sequences that lie time-major: potentials[t, s] is the row of
    sequence s at time t, with sequences sorted longest first. Returns the posteriors
    and the expected counts of the transitions into the places that are `counted`."""
    steps, n, k = potentials.shape
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    alpha = np.zeros_like(potentials)
    m = np.exp(transition).astype(potentials.dtype)
    a = potentials[0] / k
    a /= a.sum(1, keepdims=True)
    alpha[0] = a
    for t in range(1, steps):
        c = active[t]
        a = (a[:c] @ m) * potentials[t, :c]
        a /= a.sum(1, keepdims=True)
        alpha[t, :c] = a
    expected = np.zeros((k, k))
    beta = np.ones((n, k), potentials.dtype)
    out = alpha
    for t in range(steps - 1, -1, -1):
        c = active[t]
        if t + 1 < steps and (d := active[t + 1]):
            ahead = potentials[t + 1, :d] * beta[:d]
            if counted is not None:
                joint = alpha[t, :d, :, None] * m[None] * ahead[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True))[counted[t + 1, :d]].sum(0)
            b = ahead @ m.T
            beta[:d] = b / b.sum(1, keepdims=True)
        g = alpha[t, :c] * beta[:c]
        out[t, :c] = g / g.sum(1, keepdims=True)
    return out, expected


def _batches(segs, labels: int):
    """Segments in groups whose padded size stays bounded, in words times labels; sorted
    by length, a group has little padding."""
    limit = 3_200_000 // max(8, labels)
    group, longest = [], 0
    for s in segs:
        longest = longest or s[2] - s[1]
        if group and (len(group) + 1) * longest > limit:
            yield group
            group, longest = [], s[2] - s[1]
        group.append(s)
    if group:
        yield group


def _time_major(rows: list[np.ndarray], group):
    lengths = np.array([s[2] - s[1] for s in group])
    at = np.zeros((int(lengths[0]), len(group)), np.int64)
    for k, (text, a, b, _, _) in enumerate(group):
        at[: b - a, k] = rows[text][a:b]
    return at, lengths


def _inner(at: np.ndarray, group) -> np.ndarray:
    out = np.zeros(at.shape, bool)
    for k, (_, a, _, first, last) in enumerate(group):
        out[first - a : last - a, k] = True
    return out


def posteriors(crf: Crf, rows: dict[int, np.ndarray], overlap: int = OVERLAP) -> dict[int, np.ndarray]:
    """The label distribution of every word of each text; rows are the texts' words."""
    out = {k: np.zeros((len(r), len(crf.labels)), np.float32) for k, r in rows.items()}
    border: dict[int, float] = {}
    ends: dict[tuple[int, int], np.ndarray] = {}
    for group in _batches(segments({k: len(r) for k, r in rows.items()}, overlap), len(crf.labels)):
        at, lengths = _time_major(rows, group)
        e = crf.scores[at]
        found, _ = forward_backward(np.exp(e - e.max(2, keepdims=True)), lengths, crf.transition)
        for k, (text, a, _, first, last) in enumerate(group):
            out[text][first:last] = found[first - a : last - a, k]
            if first:  # the word before, which is the last inner word of the segment before
                ends[text, first - 1] = found[first - 1 - a, k].copy()
    for (text, place), x in ends.items():
        border[text] = max(border.get(text, 0.0), float(np.abs(out[text][place] - x).max()))
    again = {k: rows[k] for k, gap in border.items() if gap > CLOSE and overlap < len(rows[k])}
    return out | (posteriors(crf, again, overlap * 8) if again else {})


def _slice_bytes(crf: Crf) -> int:
    """Text that is read at once: its words' posteriors are held, a number per language."""
    return (16 << 20) // max(8, len(crf.labels))


def predict(crf: Crf, texts: list[str]) -> list[tuple[str, float]]:
    """(language, mean posterior) of each text; `und` and 0 where it has no letter."""
    split = [words(t) for t in texts]
    if not crf.labels:
        return [(UNKNOWN, 0.0)] * len(texts)
    found = posteriors(crf, {k: r for k, r in enumerate(crf.scores_of(split)) if len(r)})
    out = []
    for k in range(len(texts)):
        mean = found[k].mean(0, dtype=np.float64) if k in found else None
        out.append((UNKNOWN, 0.0) if mean is None else (crf.labels[int(mean.argmax())], min(1.0, float(mean.max()))))
    return out


def spans(crf: Crf, text: str) -> list[tuple[str, str]]:
    """(language, its words) of the runs of equally labelled words of a text."""
    split = words(text)
    if not split or not crf.labels:
        return []
    label = posteriors(crf, {0: crf.scores_of([split])[0]})[0].argmax(1)
    cut = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(split)]
    return [(crf.labels[label[a]], " ".join(split[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _lexicon(split: list[list[str]], y: list[int]) -> dict[str, list[int]]:
    """Word -> the languages among whose LEXICON most frequent words it is, by the number
    of training texts; ties go to the word that sorts first."""
    out: dict[str, list[int]] = {}
    for c in sorted(set(y)):
        count = Counter(w for s, k in zip(split, y, strict=True) if k == c for w in set(s))
        for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            out.setdefault(w, []).append(c)
    return out


def _spliced(split: list[list[str]], y: list[int], run: int = 12, runs: int = 4) -> list[tuple[list[str], list[int]]]:
    """Words and labels of texts that switch: runs of words of a text and of the next one
    of another language, in turn."""
    out = []
    for k, s in enumerate(split):
        other = next((j for j in range(k + 1, len(split)) if y[j] != y[k]), None)
        if other is not None and s and split[other]:
            pieces = [((s, y[k]) if n % 2 == 0 else (split[other], y[other]), n // 2 * run) for n in range(runs)]
            parts = [(x[a : a + run], label) for (x, label), a in pieces]
            out.append(([w for x, _ in parts for w in x], [label for x, label in parts for _ in x]))
    return out


def train(texts: list[str], langs: list[str], rounds: int = 30, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Maximise the likelihood of each text's words all being in the text's language, and
    of spliced texts' words in that of their piece, by AdaGrad on full forward-backward
    gradients. Languages are sorted by name."""
    labels = sorted(set(langs))
    split, y = [words(t) for t in texts], [labels.index(x) for x in langs]
    lexicon = _lexicon(split, y)
    sequences = [(s, [c] * len(s)) for s, c in zip(split, y, strict=True)] + _spliced(split, y)
    number = {w: k for k, w in enumerate(dict.fromkeys(w for s in split for w in s))}
    owner, found = word_features(list(number), lexicon) if number else (np.zeros(0, np.int64),) * 2
    rows = {k: np.array([number[w] for w in s], np.int64) for k, (s, _) in enumerate(sequences)}
    n, k = len(number), len(labels)
    emission, transition = np.zeros((1 << BITS, k)), np.zeros((k, k))
    seen_e, seen_t = np.full_like(emission, 1e-8), np.full_like(transition, 1e-8)
    observed, steps = np.zeros((n, k)), np.zeros((k, k))
    for r, (_, own) in zip(rows.values(), sequences, strict=True):
        np.add.at(observed, (r, np.array(own, np.int64)), 1)
        np.add.at(steps, (np.array(own[:-1], np.int64), np.array(own[1:], np.int64)), 1)
    groups = [(*_time_major(rows, g), g) for g in _batches(segments({j: len(r) for j, r in rows.items()}), k)]
    groups = [(at, lengths, _inner(at, g)) for at, lengths, g in groups]
    n_words = max(1, sum(map(len, rows.values())))
    for _ in range(rounds if n else 0):
        scores = emissions(emission, owner, found, n)
        expected, moved = np.zeros((n, k)), np.zeros((k, k))
        for at, lengths, inner in groups:
            e = scores[at]
            posterior, pairs = forward_backward(np.exp(e - e.max(2, keepdims=True)), lengths, transition, inner)
            moved += pairs
            for c in range(k):
                expected[:, c] += np.bincount(at[inner], posterior[..., c][inner], n)
        g_word = (observed - expected) / n_words * 100
        g = np.column_stack([np.bincount(found, g_word[owner, c], 1 << BITS) for c in range(k)]) - decay * emission
        seen_e += g * g
        emission += rate * g / np.sqrt(seen_e)
        g = (steps / max(1.0, steps.sum()) - moved / max(1.0, moved.sum())) * 10 - decay * transition
        seen_t += g * g
        transition += rate * g / np.sqrt(seen_t)
    return Crf(labels, emission.astype(np.float32), transition.astype(np.float32), lexicon)


def fit(docs: DataFrame, per_language: int = 150, max_rows: int = 9600, max_chars: int = 32_000_000, max_languages: int = 256) -> Crf:
    """Train on documents outside the held-out fold: per_language of each language, those
    with the smallest hash of the id, but max_rows of all languages in equal shares, and
    of these as many as have the language's share of max_chars characters (at least one).
    These bounds are what makes fitting on the driver safe; max_languages, the most
    frequent, bounds the model.

    Of rows that share id and language one text counts, that with the smallest hash, so
    repeated rows neither crowd out other documents nor use up a language's share.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(3, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    top = known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("docs")).orderBy(F.desc("docs"), "lang").limit(max_languages).collect()
    share = max(1, min(per_language, max_rows // max(1, len(top))))
    # rather more documents than wanted pass the hash threshold of their language
    limits = spark.createDataFrame([(r["lang"], min(1.0, (2 * share + 64) / max(1, r["docs"]))) for r in top], "lang string, part double")
    near = known.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("part") * F.lit(float(1 << 40)))
    near = near.groupBy("doc_id", "lang").agg(F.min(F.struct("key", F.length("text").alias("chars"))).alias("one"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id"))
    found = near.withColumn("place", place).filter(F.col("place") <= share).select("doc_id", "lang", "place", "one.*").collect()
    chosen = []
    for r in top:
        own = sorted((x for x in found if x["lang"] == r["lang"]), key=lambda x: x["place"])
        chosen += [(x["doc_id"], x["lang"], x["key"]) for x in within(own, max_chars // len(top), lambda x: x["chars"])]
    texts = known.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, lang string, key long")), ["doc_id", "lang", "key"]).dropDuplicates(["doc_id", "lang"]).select("doc_id", "lang", "text").toArrow()
    rows = sorted(zip(texts["doc_id"].to_pylist(), texts["lang"].to_pylist(), texts["text"].to_pylist(), strict=True), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return train([r[2] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs; narrow.

    A null text or one without letters is `und` with score 0; so is every text when
    there was nothing to learn from. Long texts are read whole. A null doc_id is in no fold; ties go to the
    language that sorts first; repeated rows are labelled each; other columns are
    ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf.model())  # 2**BITS rows

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("language", lambda: None)
        model = Crf(*shared.value)
        for batch in small_batches(it, limit=_slice_bytes(model)):
            texts = batch.column("text").to_pylist()
            found = predict(model, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return id_and_text(docs).withColumn("held_out", F.coalesce(held_out(3, 1), F.lit(False))).mapInArrow(batches, SCHEMA)


def language_spans(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id and `spans array<struct<lang, words>>`, the runs of words of one language
    in each text; none where a text is null or has no letter. One row per row of docs."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf.model())
    schema = "doc_id long, spans array<struct<lang: string, words: string>>"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("language", lambda: None)
        model = Crf(*shared.value)
        for batch in small_batches(it, limit=_slice_bytes(model)):
            found = [[{"lang": lang, "words": text} for lang, text in spans(model, t)] for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(batches, schema)


def keep_identified(docs: DataFrame, crf: Crf, least: float = 0.3) -> DataFrame:
    """docs without the rows whose text has no letter or whose language is uncertain
    (score under `least`); all columns stay, whatever their names, and lang becomes the
    predicted language. Null and empty texts have no letter; rows with a null doc_id and
    repeated rows count like others; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf.model())
    names = docs.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("language", lambda: None)
        model = Crf(*shared.value)
        for batch in small_batches(it, limit=_slice_bytes(model)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = predict(model, texts)
            batch = batch.set_column(names.index("lang"), "lang", pa.array([x[0] for x in found], pa.string()))
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[1] >= least for x in found], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prepare(spark)
    return identify(docs, fit(docs))
