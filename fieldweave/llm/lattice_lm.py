"""Subword lattice likelihood: the probability of a text summed over all its segmentations.

Tokens are words (A-Z lower-cased) and one end mark a text. A word is spelled by pieces of an existing subword
vocabulary, its first piece carrying the word mark; characters without a piece are spelled by byte pieces; the
end mark is a piece of its own. Piece scores start from the vocabulary's own order and are re-estimated from
the expected counts (forward-backward) of all training words. A forward recursion in log space sums all
segmentations of a word; pieces never span words, so a text's log probability is the sum over its tokens.

Words are split, counted and looked up inside the JVM; only distinct words reach the lattice. All counts are in one table;
the most frequent words (a fixed number of bounded length) are broadcast to the texts, all others meet them in a join, so no
word's count is dropped and no vocabulary is broadcast whole.

Cases: null text is empty (the end mark alone); null doc_id trains and is not held out; repeated rows count as
often as they come and are scored each; with no training rows every count is 0 and the lattice is untrained; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prefer, split_words

MARK = "▁"
#: Words broadcast to the texts, and their characters at most; all others go through the join.
FREQUENT, FREQUENT_CHARS = 100_000, 64
#: Longest word that is scored in a batch of equal lengths; longer ones one at a time.
LONG = 48
_PRIME = np.uint64(0x100000001B3)
_SMOOTH = 0.05
#: Re-estimations of the piece scores.
ROUNDS = 1


def is_held_out(doc_id: int | None, modulus: int = 7, remainder: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def load_pieces(path: str) -> tuple[list[str], list[float]]:
    """Pieces with their initial log probabilities: the existing scores give an order, ranks a Zipf law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())}
    ranked = sorted(text, key=lambda p: (-scores[p], p))
    weight = {p: 1.0 / (10 + r) for r, p in enumerate(ranked)}
    total = sum(weight.values()) * 1.05
    names = ranked + [f"<0x{b:02X}>" for b in range(256)] + [""]  # "" is the end mark
    weights = [weight[p] / total for p in ranked] + [0.01 / 256 / 1.05] * 256 + [0.04 / 1.05]
    return names, [math.log(w) for w in weights]


class Lattice:
    """Forward and forward-backward passes over many words at once."""

    def __init__(self, names: list[str], logp: list[float]):
        self.names, self.logp = names, np.array(logp)
        self.n_text = len(names) - 257
        self.longest = max(map(len, names[: self.n_text]))
        self.index = {p: i for i, p in enumerate(names[: self.n_text])}
        keys = np.array([self._hash(p) for p in names[: self.n_text]], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces of the vocabulary are the same")
        # Open addressing: a piece lies at its own slot or at the next free one after it.
        bits = max(12, (64 * max(1, len(keys))).bit_length())
        self.table, self.keys = np.full(1 << bits, -1, np.int32), np.append(keys, np.uint64(0))
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        for i, k in enumerate(keys):
            at = int(k) >> (64 - bits)
            while self.table[at] >= 0:
                at = (at + 1) & self.last
            self.table[at] = i

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return (h * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 if none."""
        h = h * np.uint64(0x9E3779B97F4A7C15)
        slot = (h >> self.shift).astype(np.int64)
        ids = self.table[slot]
        wrong = np.flatnonzero((ids >= 0) & (self.keys[ids] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.last
            ids[wrong] = self.table[slot[wrong]]
            wrong = wrong[(ids[wrong] >= 0) & (self.keys[ids[wrong]] != h[wrong])]
        return ids

    def spelled(self, c: str) -> tuple[float, list[int]]:
        ids = [self.n_text + b for b in c.encode("utf-8", "surrogatepass")]
        return float(self.logp[ids].sum()), ids

    def forward(self, words: list[str], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log probabilities of words; with counts, their expected piece counts are added to `expected`."""
        out, by_length = np.empty(len(words)), {}
        for k, w in enumerate(words):
            if not w:
                out[k] = self.logp[-1]
                if expected is not None:
                    expected[-1] += counts[k]
            else:
                by_length.setdefault(len(w), []).append(k)
        for n, at in by_length.items():
            for lo in range(0, len(at), 1 if n > LONG else 8192):
                part = at[lo : lo + (1 if n > LONG else 8192)]
                args = ([words[k] for k in part], counts[part] if counts is not None else None, expected)
                out[part] = self._one(*args) if n > LONG else self._alike(*args)
        return out

    def _alike(self, words: list[str], counts, expected) -> np.ndarray:
        K, n = len(words), len(words[0]) + 1
        chars = np.frombuffer(("".join(MARK + w for w in words)).encode("utf-32-le", "surrogatepass"), "<u4").reshape(K, n).T.astype(np.uint64)
        alpha = np.full((n + 1, K), -np.inf)
        alpha[0] = 0.0
        arcs = []
        for i in range(n):
            h = np.zeros(K, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * _PRIME + chars[j - 1] + np.uint64(1)
                h ^= h >> np.uint64(29)
                ids = self.find(h)
                use = np.flatnonzero(ids >= 0)
                lp = self.logp[ids[use]]
                if j == i + 1 and len(use) < K:
                    bare = np.flatnonzero(ids < 0)
                    codes, inverse = np.unique(chars[i][bare], return_inverse=True)
                    byte_lp = np.array([self.spelled(chr(int(c)))[0] for c in codes])[inverse]
                    alpha[j][bare] = np.logaddexp(alpha[j][bare], alpha[i][bare] + byte_lp)
                    if expected is not None:
                        arcs.append((i, j, bare, None, byte_lp))
                if len(use):
                    alpha[j][use] = np.logaddexp(alpha[j][use], alpha[i][use] + lp)
                    if expected is not None:
                        arcs.append((i, j, use, ids[use], lp))
        if expected is not None:
            beta = np.full((n + 1, K), -np.inf)
            beta[n] = 0.0
            for i, j, use, ids, lp in sorted(arcs, key=lambda a: -a[1]):
                beta[i][use] = np.logaddexp(beta[i][use], lp + beta[j][use])
            for i, j, use, ids, lp in arcs:
                share = np.exp(alpha[i][use] + lp + beta[j][use] - alpha[n][use]) * counts[use]
                if ids is not None:
                    expected += np.bincount(ids, share, len(expected))
                else:
                    for k, s in zip(use, share):
                        for b in self.spelled(chr(int(chars[i][k])))[1]:
                            expected[b] += s
        return alpha[n]

    def _arcs(self, s: str, i: int):
        """(end, log probability, pieces) of the arcs of s that start at i."""
        for j in range(i + 1, min(len(s), i + self.longest) + 1):
            p = self.index.get(s[i:j])
            if p is not None:
                yield j, float(self.logp[p]), (p,)
            elif j == i + 1:
                value, ids = self.spelled(s[i])
                yield j, value, ids

    def _one(self, words: list[str], counts, expected) -> np.ndarray:
        """One long word; arcs are made anew for each pass, so two numbers a character are held."""
        s = MARK + words[0]
        n = len(s)
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0.0
        for i in range(n):
            for j, v, _ in self._arcs(s, i):
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + v)
        if expected is not None:
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0.0
            for i in range(n - 1, -1, -1):
                for j, v, ids in self._arcs(s, i):
                    beta[i] = np.logaddexp(beta[i], v + beta[j])
                    share = math.exp(min(0.0, alpha[i] + v + beta[j] - alpha[n])) * counts[0]
                    for p in ids:
                        expected[p] += share
        return alpha[n:]


def _buffered(batches, rows: int = 100_000):
    """Larger batches: words of one length then meet in larger arrays."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _reestimated(words: DataFrame, names: list[str], logp: list[float]) -> list[float]:
    """Piece log probabilities from the expected counts of all training words."""

    def expect(batches):
        lattice, expected = Lattice(names, logp), np.zeros(len(names))
        for b in _buffered(batches):
            lattice.forward(b["token"].to_pylist(), b["c"].to_numpy(zero_copy_only=False).astype(float), expected)
        at = np.flatnonzero(expected)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(expected[at])], ["piece", "x"])

    found = np.full(len(names), _SMOOTH)
    seen = words.where("c > 0").select("token", "c").mapInArrow(expect, "piece int, x double").groupBy("piece").agg(F.sum("x"))
    for piece, x in seen.collect():  # at most one row a piece
        found[piece] += x
    return np.log(found / found.sum()).tolist()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lattice_scores(docs: DataFrame, vocabulary: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    # Row numbers are written with the texts, so that each later scan sees the same ones.
    texts = scratch.write(prefer(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "texts")
    split = texts.select("row", F.when(held, 0).otherwise(1).alias("t"), split_words(F.col("text")).alias("w"))

    # Words as they are written; distinct ones are lower-cased. The end mark is the token "". explode_outer: for explode, a filter
    # on w would be inferred and computed as well.
    raw = split.select("t", F.explode_outer("w").alias("raw")).groupBy("raw").agg(F.sum("t").alias("c"), F.count("*").alias("n")).where("raw is not null")
    raw = scratch.write(raw.withColumn("token", F.translate("raw", _UPPER, _LOWER)), "raw")
    ends = texts.select(F.lit("").alias("token"), F.when(held, 0).otherwise(1).alias("c"))
    words = scratch.write(raw.select("token", "c").union(ends).groupBy("token").agg(F.sum("c").alias("c")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    names, logp = load_pieces(vocabulary)
    for _ in range(ROUNDS if total else 0):
        logp = _reestimated(words, names, logp)

    def score(batches):
        lattice = Lattice(names, logp)
        for b in _buffered(batches):
            yield pa.RecordBatch.from_arrays([b["token"], b["c"], pa.array(lattice.forward(b["token"].to_pylist()) / math.log(10))], ["token", "c", "lp"])

    scored = scratch.write(words.mapInArrow(score, "token string, c long, lp double"), "scored")
    known = scratch.write(raw.select("raw", "n", "token").join(scored, "token").select("raw", "n", F.log10(F.col("c") + 1).alias("base"), (F.col("c") > 0).cast("long").alias("hit"), "lp"), "known")
    top = scratch.write(known.where(F.length("raw") <= FREQUENT_CHARS).orderBy(F.desc("n"), "raw").limit(frequent).drop("n"), "top")
    scratch.drop(raw, words)

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(F.sum("base").alias("base"), F.sum("hit").alias("hit"), F.sum("lp").alias("lp"))

    tokens = split.select("row", F.explode_outer("w").alias("raw"))
    common = summed(tokens.join(F.broadcast(top), "raw", "left"))
    rare = tokens.where("raw is not null").join(F.broadcast(top.select("raw")), "raw", "left_anti").groupBy("row", "raw").agg(F.count("*").alias("k"))
    rare = rare.join(known.join(F.broadcast(top.select("raw")), "raw", "left_anti"), "raw")
    rare = summed(rare.select("row", *[(F.col(x) * F.col("k")).alias(x) for x in ("base", "hit", "lp")]))
    end = scored.where("token = ''").first()  # None for an empty table
    c, lp = (end.c, end.lp) if end else (0, 0.0)
    n_tokens = texts.select("row", "doc_id", (F.size(split_words(F.col("text"))) + 1).cast("long").alias("n_tokens"))
    both = common.union(rare).groupBy("row").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("base", "hit", "lp")])
    rows = n_tokens.join(both, "row")
    floor = math.log10(total + distinct + 1)
    base = F.col("base") + F.lit(math.log10(c + 1)) - F.col("n_tokens") * F.lit(floor)
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("hit") + F.lit(int(c > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lp") + F.lit(lp)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
