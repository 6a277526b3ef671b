"""Subject areas of documents: term weighting, truncated SVD, and seed centroids refined iteratively.

1. Seeds. From a bounded sample of labelled documents (``LABELLED``, a parameter), words that documents of a subject
   hold far more often than others are found; their association is the logarithm of the lift.
2. Vocabulary. Over all documents, words that mostly occur in sentences whose other words speak for one subject make
   up the vocabulary of at most ``VOCABULARY`` words; seeds that don't are dropped, others join. Twice.
3. Embedding. The vocabulary words of every sentence of every document are written as small numbers. From their
   weighted co-occurrence over all sentences, a truncated SVD gives each word a vector; a sentence is the sum of
   its words' vectors.
4. Assignment. Sentences go to the nearest centroid by cosine similarity; centroids start from the seeds, one per
   subject and language, and are recomputed from the sentences assigned to them for some rounds. A
   document gets each subject that at least ``SENTENCES`` of its sentences are about.

Only the vocabulary, its co-occurrence sums and the centroids reach the driver, all of a size bounded by parameters.

Defined results: null, empty and wordless texts have no subject; labels are read without case and outer blanks, unknown
and missing ones are ignored and ``none`` only counts as background; without labels nothing is assigned; repeated
documents get equal subjects; texts of any length are used whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.llm.words import Words, parts
from tessaria.runtime import BLANKS, checked_broadcast, materialize

#: The subjects of the project's data.
SUBJECTS = ("software", "law", "health", "finance", "energy", "sport", "science", "transport")
#: Bounds: labelled documents used as seeds, words of the vocabulary, languages with centroids of their own.
LABELLED, VOCABULARY, LANGUAGES = 50_000, 2048, 8
#: Dimensions of the embedding and rounds of refinement.
RANK, ROUNDS = 128, 2
#: A word is a seed from this lift and this excess in standard deviations.
LIFT, EXCESS = 2.0, 2.5
#: A word belongs to the vocabulary from this share and number of sentences in the company of one subject's words; rounds.
PURE, COMPANY, GROWTH = 0.5, 3, 2
#: Cosine, summed association and distinct vocabulary words from which a sentence is about a subject (one word alone
#: is no evidence), and sentences that make a subject.
NEAR, MASS, WORDS, SENTENCES = 0.15, 1.0, 2, 2

#: Bits of a word's hash that count here; they share a word with the number of a sentence or of a group.
_BITS = np.uint64(48)
_OFF = np.uint64(16)


def _sentences(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Words of the texts and the number of the sentence (over all texts) that each word is in.

    A line end, or a full stop, question or exclamation mark before white space, ends a sentence.
    """
    w = Words(texts)
    d = w.data
    stop = (d == 46) | (d == 33) | (d == 63)
    nxt = np.append(d[1:], np.uint8(10))
    ends = (d == 10) | (stop & ((nxt == 32) | (nxt == 10) | (nxt == 9) | (nxt == 13)))
    return w, np.cumsum(ends)[w.start]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in parts(size):
        part = batch.slice(a, b - a)
        yield part, *_sentences([x or "" for x in part.column(column).to_pylist()])


def _hashes(w: Words) -> np.ndarray:
    return w.hashes() >> _OFF


def _distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (word, number of sentence or text), ordered by the number; 65536 numbers at a time."""
    out = []
    step = 1 << 16
    for a in range(0, int(of[-1]) + 1 if len(of) else 0, step):
        lo, hi = np.searchsorted(of, (a, a + step))
        k = np.sort((of[lo:hi] - a).astype(np.uint64) << _BITS | h[lo:hi])
        k = k[np.append(True, k[1:] != k[:-1])] if len(k) else k
        out.append((k & np.uint64((1 << 48) - 1), (k >> _BITS).astype(np.int64) + a))
    if not out:
        return h, of
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _counted(h: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """Numbers of (word, group) pairs; groups are -1 to 254."""
    k, n = np.unique(h << np.uint64(8) | (group + 1).astype(np.uint64), return_counts=True)
    return _rows(k >> np.uint64(8), (k & np.uint64(255)).astype(np.int64) - 1, n)


def _rows(word: np.ndarray, group: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "grp": pa.array(group, pa.int32()), "n": pa.array(n, pa.int64())})


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, groups) -> documents by word and group, the group -1 being all."""
    for batch in batches:
        groups = batch.column(1).to_pylist()
        at = 0
        for part, w, _ in _texts(batch, 0):
            own = groups[at : at + part.num_rows]
            at += part.num_rows
            h, t = _distinct(_hashes(w), w.text)
            size = np.array([len(g) + 1 for g in own])
            flat = np.concatenate([np.array([-1, *g]) for g in own]) if own else np.empty(0, int)
            first = np.cumsum(size) - size
            many = size[t]
            run = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            g = flat[np.repeat(first[t], many) + run]
            if len(g):
                yield _counted(np.repeat(h, many), g)


@dataclass
class Seeds:
    """Sorted word hashes, association of each with each group (subject times language), and the group's names."""

    words: np.ndarray
    weight: np.ndarray


def _wanted(labels: DataFrame) -> DataFrame:
    """(doc_id, subjects array) of a sample of at most LABELLED labelled documents, chosen by hash."""
    name = F.lower(F.btrim("subject", F.lit(BLANKS)))
    known = labels.select("doc_id", name.alias("s")).filter("doc_id is not null").filter(F.col("s").isin(*SUBJECTS, "none"))
    return known.groupBy("doc_id").agg(F.collect_set("s").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)


def find_seeds(documents: DataFrame, labels: DataFrame) -> Seeds:
    wanted = checked_broadcast(materialize(_wanted(labels), "labelled"), LABELLED)
    docs = materialize(documents.join(wanted, "doc_id").select("text", F.coalesce("lang", F.lit("")).alias("lang"), "subjects"), "seeds")
    languages = [r.lang for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES - 1).collect()]
    spot = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) if languages else F.lit(0)
    at = F.when(spot > 0, spot - 1).otherwise(LANGUAGES - 1)  # the last place is for all other languages
    code = lambda s: F.when(s == "none", -2).otherwise(F.array_position(F.array(*map(F.lit, SUBJECTS)), s) - 1)
    groups = F.filter(F.transform("subjects", lambda s: F.when(s == "none", F.lit(-2)).otherwise(code(s) * LANGUAGES + at).cast("int")), lambda g: g >= 0)
    coded = docs.select("text", groups.alias("groups"))
    n = len(SUBJECTS) * LANGUAGES
    sizes = np.zeros(n)
    for r in coded.select(F.explode("groups").alias("g")).groupBy("g").count().collect():
        sizes[r.g] = r["count"]
    total = docs.count()
    by_subject = sizes.reshape(len(SUBJECTS), LANGUAGES).sum(axis=1)
    counts = coded.mapInArrow(_label_counts, "word long, grp int, n long").groupBy("word", "grp").agg(F.sum("n").alias("n"))
    subject = F.when(F.col("grp") < 0, -1).otherwise(F.floor(F.col("grp") / LANGUAGES)).cast("int")
    table = counts.groupBy("word", subject.alias("s")).agg(F.sum("n").alias("n")).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("m"))
    share = F.array(*[F.lit(float(x) / max(total, 1)) for x in by_subject])
    seen = F.col("m")[-1]
    excess = [(F.coalesce(F.col("m")[i], F.lit(0)) - seen * share[i]) / F.sqrt(seen * share[i] + 1e-9) for i in range(len(SUBJECTS))]
    lift = [F.coalesce(F.col("m")[i], F.lit(0)) / (seen * share[i] + 1e-9) for i in range(len(SUBJECTS))]
    best = F.greatest(*[F.when(li >= LIFT, ex).otherwise(0.0) for li, ex in zip(lift, excess, strict=True)])
    chosen = materialize(table.withColumn("score", best).filter((F.col("score") >= EXCESS) & (seen >= 2)).orderBy(F.desc("score"), "word").limit(VOCABULARY // 2).select("word", "m"), "chosen")
    rows = chosen.collect()  # at most VOCABULARY / 2
    langs = counts.join(F.broadcast(chosen.select("word")), "word").filter("grp >= 0").collect()  # times the groups
    words = np.array(sorted(r.word for r in rows), dtype=np.int64).view(np.uint64)
    words = np.sort(words)
    place = {int(w): i for i, w in enumerate(words.view(np.int64))}
    spread = np.zeros((len(words), n))
    for r in langs:
        spread[place[r.word], r.grp] = r.n
    spread = spread.reshape(len(words), len(SUBJECTS), LANGUAGES)
    weight = np.zeros_like(spread)
    for r in rows:
        i = place[r.word]
        for s in range(len(SUBJECTS)):
            up = r.m.get(s, 0) / (r.m[-1] * by_subject[s] / max(total, 1) + 1e-9)
            if up >= 1.5 and spread[i, s].sum():
                weight[i, s] = np.log(up) * spread[i, s] / spread[i, s].sum()
    return Seeds(words, weight.reshape(len(words), n))


def _find(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    k = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return k, words[k] == h


def _company(seeds):
    """Words by the company they keep: sentences with the word, by the group that the *other* words speak for, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        weight = s.weight.astype(np.float32)
        for batch in batches:
            for _, w, sentence in _texts(batch, 0):
                if not len(w.start):
                    continue
                h, sentence = _distinct(_hashes(w), sentence)
                k, hit = _find(s.words, h)
                heard, inverse = np.unique(sentence[hit], return_inverse=True)
                score = np.zeros((len(heard), weight.shape[1]), dtype=np.float32)
                np.add.at(score, inverse, weight[k[hit]])
                at = np.minimum(np.searchsorted(heard, sentence), max(0, len(heard) - 1))
                near = np.flatnonzero(heard[at] == sentence) if len(heard) else np.empty(0, int)
                group = np.full(len(h), -1)
                if len(near):
                    group[near] = np.where(score.max(axis=1) >= MASS, score.argmax(axis=1), -1)[at[near]]
                    own = near[hit[near]]  # a word doesn't speak for itself
                    rest = score[at[own]] - weight[k[own]]
                    group[own] = np.where(rest.max(axis=1) >= MASS, rest.argmax(axis=1), -1)
                yield _counted(h, group)

    return run


def grow_vocabulary(documents: DataFrame, seeds: Seeds) -> Seeds:
    """The words, seeds or not, whose occurrences over all documents lie in the company of one subject's words."""
    shared = documents.sparkSession.sparkContext.broadcast(seeds)
    counts = documents.select("text").mapInArrow(_company(shared), "word long, grp int, n long").groupBy("word", "grp").agg(F.sum("n").alias("n"))
    subject = F.floor(F.col("grp") / LANGUAGES).cast("int")
    by_subject = counts.groupBy("word", subject.alias("s")).agg(F.sum("n").alias("n"), F.max_by("grp", "n").alias("grp"))
    top = by_subject.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.when(F.col("s") >= 0, F.struct("n", "grp"))).alias("b"))
    pure = top.filter((F.col("b.n") >= PURE * F.col("total")) & (F.col("b.n") >= COMPANY)).orderBy(F.desc("b.n"), "word").limit(VOCABULARY)
    rows = pure.select("word", "b.grp", (F.col("b.n") / F.col("total")).alias("share")).collect()  # at most VOCABULARY
    words = np.array([r.word for r in rows], dtype=np.int64).view(np.uint64)
    weight = np.zeros((len(words), seeds.weight.shape[1]))
    old, known = _find(seeds.words, words)
    for i, r in enumerate(rows):
        s, own = r.grp // LANGUAGES, seeds.weight[old[i]].reshape(len(SUBJECTS), LANGUAGES)
        if known[i] and own.sum(axis=1).argmax() == s:
            weight[i] = own.ravel()
        else:
            weight[i, r.grp] = 1.5 * r.share
    order = np.argsort(words)
    return Seeds(words[order], weight[order])


ENCODED = "doc_id long, cuts array<int>, terms array<int>"


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value.words
        for batch in batches:
            for part, w, sentence in _texts(batch, 1):
                h = _hashes(w)
                k, hit = _find(words, h)
                k, s, t = k[hit], sentence[hit], w.text[hit]
                if not len(k):
                    continue
                order = np.lexsort((k, s))
                k, s, t = k[order], s[order], t[order]
                keep = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
                k, s, t = k[keep], s[keep], t[keep]
                begin = np.append(True, s[1:] != s[:-1])
                docs, at = np.unique(t, return_index=True)
                upto = np.append(at, len(t))
                cuts, lens = [], []
                starts = np.flatnonzero(begin)
                of = np.searchsorted(at, starts, side="right") - 1
                rel = (starts - at[of]).astype(np.int32)
                lens = np.bincount(of, minlength=len(docs))
                cuts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(rel))
                terms = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(k.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs)), cuts, terms], names=["doc_id", "cuts", "terms"])

    return run


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, the sentence (over the batch) of each, and the row of each sentence."""
    cuts, terms = batch.column(1), batch.column(2)
    first = terms.offsets.to_numpy()
    lens = np.diff(cuts.offsets.to_numpy())
    row = np.repeat(np.arange(len(lens)), lens)
    flat_cuts = cuts.flatten().to_numpy().astype(np.int64)
    starts = flat_cuts + (first[:-1] - first[0])[row]
    flat = terms.flatten().to_numpy()
    mark = np.zeros(len(flat), dtype=np.int64)
    mark[starts] = 1
    return flat, np.cumsum(mark) - 1, row


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Co-occurrence of terms in sentences, i <= j, in sums per batch."""
    for batch in batches:
        term, sentence, _ = _unpack(batch)
        size = np.bincount(sentence)
        end = np.cumsum(size)
        later = end[sentence] - np.arange(len(term))
        total = int(later.sum())
        i = np.repeat(np.arange(len(term)), later)
        j = i + np.arange(total) - np.repeat(np.cumsum(later) - later, later)
        both, n = np.unique(term[i].astype(np.int64) * VOCABULARY + term[j], return_counts=True)
        yield pa.RecordBatch.from_pydict({"i": pa.array((both // VOCABULARY).astype(np.int32)), "j": pa.array((both % VOCABULARY).astype(np.int32)), "n": pa.array(n)})


@dataclass
class Model:
    vector: np.ndarray  # of each word, by its inverse frequency
    mass: np.ndarray  # largest association of each word with a subject
    centroid: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def embed(encoded: DataFrame, vocabulary: Seeds) -> Model:
    """Truncated SVD of the weighted term-by-sentence matrix, by way of its Gram matrix."""
    n = len(vocabulary.words)
    gram = np.zeros((n, n))
    sums = encoded.mapInArrow(_pairs, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most VOCABULARY squared / 2 rows of 16 bytes
    i, j, many = (found.column(c).to_numpy() for c in ("i", "j", "n"))
    gram[i, j] = gram[j, i] = many
    degree = gram.sum(axis=1)  # frequent company weighs a word down, so that small languages and subjects count as much
    weight = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1)), 0)
    values, vectors = np.linalg.eigh(gram * weight[:, None] * weight[None, :])
    top = np.argsort(-values)[:RANK]
    by_subject = vocabulary.weight.reshape(n, len(SUBJECTS), LANGUAGES).sum(axis=2)
    vector = _unit(vectors[:, top] * np.sqrt(np.maximum(values[top], 0)))  # a word's place in the latent space
    seeds = vocabulary.weight.T @ vector
    return Model(vector.astype(np.float32), by_subject.max(axis=1), _unit(seeds).astype(np.float32))


def _judge(model: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vector, nearest group, whether it is about it, and row of each sentence."""
    term, sentence, row = _unpack(batch)
    start = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
    x = _unit(np.add.reduceat(model.vector[term], start, axis=0))
    mass = np.add.reduceat(model.mass[term], start)
    near = x @ model.centroid.T
    top = near.argmax(axis=1)
    many = np.diff(np.append(start, len(term)))
    return x, top, (near.max(axis=1) >= NEAR) & (mass >= MASS) & (many >= WORDS), row


def _refine(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(model.value.centroid, dtype=np.float64)
        for batch in batches:
            if batch.num_rows:
                x, top, about, _ = _judge(model.value, batch)
                np.add.at(total, top[about], x[about])
        group, place = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"g": pa.array(group.astype(np.int32)), "d": pa.array(place.astype(np.int32)), "x": pa.array(total[group, place])})

    return run


def _assign(model):
    schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, top, about, row = _judge(model.value, batch)
            both, n = np.unique(row[about] * len(SUBJECTS) + top[about] // LANGUAGES, return_counts=True)
            both = both[n >= SENTENCES]
            names = pa.array([SUBJECTS[i] for i in both % len(SUBJECTS)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both // len(SUBJECTS))), names], schema=schema)

    return run


def subject_areas(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject) of every document and each of its subjects."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("text is not null and doc_id is not null")
    seeds = find_seeds(docs, labels)
    if not len(seeds.words):
        return spark.createDataFrame([], "doc_id long, subject string")
    vocabulary = seeds
    for _ in range(GROWTH):
        vocabulary = grow_vocabulary(docs, vocabulary)
    if not len(vocabulary.words):
        return spark.createDataFrame([], "doc_id long, subject string")
    share = spark.sparkContext.broadcast
    encoded = materialize(docs.select("doc_id", "text").mapInArrow(_encode(share(vocabulary)), ENCODED), "encoded")
    model = embed(encoded, vocabulary)
    for _ in range(ROUNDS):
        sums = encoded.mapInArrow(_refine(share(model)), "g int, d int, x double").groupBy("g", "d").agg(F.sum("x").alias("x")).toArrow()  # as many numbers as the centroids have
        total = np.zeros(model.centroid.shape)
        total[sums.column("g").to_numpy(), sums.column("d").to_numpy()] = sums.column("x").to_numpy()
        some = np.linalg.norm(total, axis=1) > 0
        model.centroid[some] = _unit(total[some]).astype(np.float32)
    return encoded.mapInArrow(_assign(share(model)), "doc_id long, subject string")
