"""Toxicity by weak supervision.

Voters are lexicons and patterns: a short general lexicon of insults; words and word beginnings mined from labelled training
rows, in lexicons by purity; how many of them a text holds, how densely, where and in what company; shouting and symbol
runs; and some that vote "clean" where nothing is found. The given labels are no voter. A generative label model (EM over
the distinct vote patterns) estimates each voter's accuracy; voters that tell no more than the prior get no weight, and
correlations given the label lower the weight of voters that say the same thing twice.
A linear classifier is trained on the model's posterior labels and scores every whole text.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2, from at most SAMPLE_ROWS of them (those
with the smallest id hashes); everything else covers all documents. All terms of the sample that pass the tests of purity and
chance are used. Labels, lang, source and doc_id are never inputs of a score.

Cases: null or empty text scores as a text without any hit; null doc_id is not held out; repeated label rows
count as toxic if one of them is; without labels only the general lexicon and the patterns score; repeated
documents are scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prefer, slices

#: Labelled training rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 40_000
LEAST_ROWS, PURITY = 4, 0.4
#: Chance of any candidate term being mined although it tells nothing (a bound over all candidates together).
CHANCE = 0.01
#: Lower bounds of purity of the lexicons of mined words, and of mined word beginnings.
GRADES = (0.4, 0.6, 0.8, 0.95)
#: Words whose terms a reader remembers.
CACHE_WORDS = 100_000
THRESHOLD = 0.3

#: A general lexicon of insults.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash clown worthless pathetic disgusting bastard imbecile jerk fool filth vermin retard".split())

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]{3}")
_SHOUT = re.compile(r"\b[^\W\d_a-z]{3,}!!")
PATTERNS = ("likely", "sure", "dense", "two", "four", "early", "middle", "late", "close", "loud", "shout", "symbols", "nothing", "no word", "no lexicon")
VOTERS = 1 + 2 * len(GRADES) + len(PATTERNS)


def _prefixes(word: str):
    return [word[:k] + "-" for k in (4, 5, 6, 7, 8) if len(word) > k]


def _keyed(batches):
    """Adds three minima of hashed word triples, which near copies share, and a hash of the text."""
    import xxhash

    for batch in batches:
        for part in slices(batch, 256):
            keys = []
            for text in part["text"].to_pylist():
                w = _WORD.findall(text.lower())
                shingles = np.array([xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], np.uint64)
                keys.append([int((shingles * m).min() >> np.uint64(1)) for m in _MULTIPLIERS] + [xxhash.xxh3_64_intdigest(text) >> 1])
            columns = [pa.array(c, pa.int64()) for c in zip(*keys)] if keys else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([part["text"], part["toxic"].cast(pa.int32()), *columns], ["text", "toxic", "key1", "key2", "key3", "tie"])


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


@dataclass
class Model:
    """terms: mined term -> feature; purity: the share of toxic rows among those with the term; prior: that of all rows; weights: of
    terms, then of the voters; bias."""

    terms: dict[str, int]
    purity: list[float]
    prior: float
    weights: np.ndarray
    bias: float

    def reader(self):
        return _Reader(self.terms, self.purity, self.prior)

    def score(self, features: list[int]) -> float:
        z = self.bias + float(self.weights[features].sum())
        return float(1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z)))))


class _Reader(dict):
    """word -> the mined terms that it shows; votes and features of a text."""

    def __init__(self, terms: dict[str, int], purity: list[float], prior: float):
        super().__init__()
        self.terms = terms
        self.lexicon = [1 + sum(q >= g for g in GRADES[1:]) + len(GRADES) * (t[-1] == "-") for t, q in zip(sorted(terms, key=terms.get), purity)]
        self.start = float(np.log(prior / (1 - prior)))
        self.odds = [float(np.log(min(q, 0.98) / (1 - min(q, 0.98)))) - self.start for q in purity]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        get = self.terms.get
        found = tuple(i for i in map(get, [word, *_prefixes(word)]) if i is not None)
        if word in INSULTS:
            found += (-1,)
        self[word] = found
        return found

    def read(self, text: str | None) -> tuple[tuple[int, ...], list[int]]:
        text = text or ""
        words = _WORD.findall(text.lower())
        at = [k for k, w in enumerate(words) if self[w]]
        seen = {h for k in at for h in self[words[k]]}
        votes = [0] * VOTERS
        if -1 in seen:
            votes[0] = 1
            seen.discard(-1)
        for i in seen:
            votes[self.lexicon[i]] = 1
        n, first = len(words), 1 + 2 * len(GRADES)
        shown = {words[k] for k in at}
        distinct = len(shown)
        odds = self.start + sum(max((self.odds[i] for i in self[w] if i >= 0), default=0.0) for w in shown)
        votes[first:] = [
            int(odds > 0),
            int(odds > 3),
            int(bool(at) and len(at) * 300 >= n),
            int(distinct >= 2),
            int(distinct >= 4),
            int(any(3 * k < n for k in at)),
            int(any(n <= 3 * k < 2 * n for k in at)),
            int(any(3 * k >= 2 * n for k in at)),
            int(any(b - a <= 10 for a, b in zip(at, at[1:]))),
            int(bool(at) and any(words[k].upper() in text for k in at)),
            int(bool(_SHOUT.search(text))),
            int(bool(_SYMBOLS.search(text))),
            -int(not at),
            -int(not any(votes[1 : 1 + len(GRADES)])),
            -int(not votes[0]),
        ]
        m = len(self.terms)
        return tuple(votes), sorted(seen) + [m + v for v in range(VOTERS) if votes[v]]


class LabelModel:
    """Naive Bayes over votes (-1, 0, 1) with a hidden label, fitted by EM on pattern counts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, balance: float, rounds: int = 50):
        """balance: the share of toxic rows, which is given; all else is estimated. (With a free share, few patterns may lead
        the rounds to a label of its own that no voter for toxic texts supports.)"""
        onehot = np.eye(3)[patterns + 1]  # [pattern, voter, vote]
        positive = (patterns == 1).sum(1) - 2 * (patterns == -1).sum(1)
        post = np.clip(0.5 + 0.2 * positive, 0.02, 0.98)
        self.weight = np.ones(patterns.shape[1])
        self.prior = float(np.clip(balance, 1e-3, 0.5))
        for _ in range(rounds):
            w1, w0 = counts * post, counts * (1 - post)
            self.p1 = (np.einsum("n,nmv->mv", w1, onehot) + 0.5) / (w1.sum() + 1.5)
            self.p0 = (np.einsum("n,nmv->mv", w0, onehot) + 0.5) / (w0.sum() + 1.5)
            self._weigh(patterns, counts, post)
            post = self.posterior(patterns)

    def _weigh(self, patterns: np.ndarray, counts: np.ndarray, post: np.ndarray) -> None:
        """Weights of voters by their accuracies and by their correlations given the label: voters that move together share one voice."""
        total = 0.0
        for w, p in ((counts * post, self.p1), (counts * (1 - post), self.p0)):
            centred = patterns - p @ np.array([-1.0, 0.0, 1.0])
            cov = np.einsum("n,ni,nj->ij", w, centred, centred) / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            total = total + w.sum() / counts.sum() * np.abs(cov / np.outer(sd, sd))
        self.correlation = total
        # Accuracy: how often a voter that votes is right, against what the prior alone would give it.
        yes, no = self.p1 * self.prior, self.p0 * (1 - self.prior)
        given = np.maximum(yes[:, 0] + yes[:, 2] + no[:, 0] + no[:, 2], 1e-12)
        self.accuracy = (yes[:, 2] + no[:, 0]) / given
        by_chance = (self.prior * (yes[:, 2] + no[:, 2]) + (1 - self.prior) * (yes[:, 0] + no[:, 0])) / given
        self.weight = (self.accuracy > by_chance) / np.maximum(1.0, total.sum(1) - np.diag(total) + 1.0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = np.arange(patterns.shape[1])
        z = np.log(self.prior / (1 - self.prior)) + ((np.log(self.p1) - np.log(self.p0))[at, patterns + 1] * self.weight).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(rows: list[list[int]], target: np.ndarray, size: int, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features and soft labels, by gradient steps with momentum."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids = np.array([i for r in rows for i in r], int)
    w, b = np.zeros(size), float(np.log(np.clip(target.mean(), 1e-3, 0.5) / (1 - np.clip(target.mean(), 1e-3, 0.5))))
    vw, vb, df = np.zeros(size), 0.0, np.bincount(ids, minlength=size) + 10.0
    for _ in range(rounds):
        z = b + np.bincount(at, w[ids], len(rows))
        e = target - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        vw = 0.9 * vw + 0.3 * (np.bincount(ids, e[at], size) / df - 1e-3 * w)
        vb = 0.9 * vb + 0.3 * e.mean()
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> Model:
    """The classifier, from the training rows of labels."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxicity")
    train = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    chosen = train.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    marked = prefer(docs, "doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    keyed = scratch.write(marked.mapInArrow(_keyed, "text string, toxic int, key1 long, key2 long, key3 long, tie long"), "keyed")
    # Copies of one text would make each of its words look telling, so one of each group of copies is learned from.
    one = keyed.drop("text", "toxic")
    for k in ("key1", "key2", "key3"):
        one = one.groupBy(k).agg(F.min_by(F.struct(*[c for c in one.columns if c != k]), "tie").alias("r")).select(k, "r.*")
    sample = scratch.write(keyed.join(F.broadcast(one.select("tie").distinct()), "tie", "left_semi").dropDuplicates(["tie"]).select("text", "toxic"), "sample")

    def terms(words: set[str]) -> set[str]:
        return {w for w in words if len(w) >= 3} | {p for w in words for p in _prefixes(w)}

    def counted(batches):
        kinds = [Counter(), Counter()]

        def flush():
            found = list(kinds[0].keys() | kinds[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *[pa.array([k[t] for t in found], pa.int64()) for k in kinds]], ["term", "clean", "toxic"])
            for k in kinds:
                k.clear()
            return out

        for batch in batches:
            for part in slices(batch, 256):
                for text, toxic in zip(part["text"].to_pylist(), part["toxic"].to_pylist()):
                    kinds[toxic != 0].update(terms(set(_WORD.findall(text.lower()))))
                if len(kinds[0]) + len(kinds[1]) > 200_000:
                    yield flush()
        yield flush()

    known = sample.mapInArrow(counted, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    known = scratch.write(known.where(F.col("toxic") >= LEAST_ROWS), "terms")
    n_rows, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") != 0).cast("int")), F.lit(0))).first()
    prior, needed = min(max(n_toxic / max(1, n_rows), 1e-6), 1 - 1e-6), float(np.log(max(1, known.count()) / CHANCE))
    n, q = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    evidence = q * F.log(q / prior) + (1 - q) * F.log(F.greatest(1 - q, F.lit(1e-12)) / (1 - prior))
    # The sample is bounded, and with it the terms that tell something.
    pure = known.where((q >= PURITY) & (n * evidence >= needed)).select("term", q.alias("q")).orderBy("term").collect()
    index = {r.term: i for i, r in enumerate(pure)}
    purity = [r.q for r in pure]

    def read(batches):
        reader = _Reader(index, purity, prior)
        for batch in batches:
            for part in slices(batch, 256):
                votes, features = zip(*map(reader.read, part["text"].to_pylist())) if part.num_rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(map(list, votes)), pa.list_(pa.int32())), pa.array(features, pa.list_(pa.int32()))], ["votes", "features"])

    rows = sample.mapInArrow(read, "votes array<int>, features array<int>").collect()  # at most SAMPLE_ROWS
    scratch.drop(sample, keyed, known)
    size = len(index) + VOTERS
    if not rows:
        weights = np.zeros(size)
        weights[len(index)] = 5.0
        return Model(index, purity, prior, weights, -3.0)
    rows.sort(key=lambda r: (r.votes, r.features))
    patterns = Counter(tuple(r.votes) for r in rows)
    votes = np.array(list(patterns), int)
    model = LabelModel(votes, np.array(list(patterns.values()), float), prior)
    posterior = dict(zip(patterns, model.posterior(votes)))
    weights, bias = _train([r.features for r in rows], np.array([posterior[tuple(r.votes)] for r in rows]), size)
    return Model(index, purity, prior, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs."""
    model = fit(docs, labels)

    def run(batches):
        reader = model.reader()
        for batch in batches:
            for part in slices(batch, 256):
                scores = [model.score(reader.read(t)[1]) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = prefer(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns and whole texts."""
    model = fit(docs, labels)

    def run(batches):
        reader = model.reader()
        for batch in batches:
            for part in slices(batch, 256):
                keep = [model.score(reader.read(t)[1]) < THRESHOLD for t in part["text"].to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
