"""Scoring texts with a hashed maximum-entropy language model.

A token's probability is that of its class given the words before it, times that
of the token in its class. The class has a softmax over hashed features: the last
word, the last two together, and the second and third last alone (skips). Inside a
class tokens have add-half frequencies, with one share for unknown tokens. Classes
come from the data: words with one ending form a bucket, buckets that follow like words
are clustered.

Counts, co-occurrences and gradients are gathered over all training texts. Each
task makes adaptive gradient updates on the texts of its partition, in numpy
batches; the weights of all tasks are averaged by their tokens, in a tree of bounded fan-in.
The table of hashed features grows with the training tokens, from MIN_ROWS up to
MAX_ROWS rows, which is what a task can hold (32 MB of weights); the counts grow without limit.

The most frequent words (at most FREQUENT) travel with the job; all others are
joined to the table of counts, so every count is exact.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringweave.llm.bpe import groups
from ringweave.llm.common import crc_of, documents
from ringweave.session import stage

FREQUENT = 150_000
BUCKETS, CONTEXTS, CLASSES = 2048, 128, 32  # class 0 is the end
MIN_ROWS, MAX_ROWS, TOKENS_A_ROW = 1 << 15, 1 << 18, 512  # of the weights of hashed features
BATCH = 1 << 12
LAYERS = 16
RATE = 0.6
GROUP_CHARS = 1 << 22
PIECE = 512  # rows of the weights that travel together
FAN_IN, LEVELS = 256, 3  # tasks whose pieces are averaged in one group; three levels are 16 M tasks
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_of(F.col(id_col)) % 5 == 1


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().split()


def words_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What ``tokens_of`` gives for many texts: the distinct words, the number of each word in them, and words a text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(pa.array(texts, pa.string()), "")))
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    sizes = np.bincount(text[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), sizes


def rows_for(tokens: int) -> int:
    """Rows of the table of hashed features: a power of two that grows with the training tokens."""
    return min(MAX_ROWS, max(MIN_ROWS, 1 << (max(tokens // TOKENS_A_ROW, 1).bit_length() - 1)))


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def count_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """Written table ``word, cell, n``: counts of words, and of (bucket, hash of the word before) as cells."""

    def run(batches):
        for batch in batches:
            words: dict[bytes, int] = {}
            cells = np.zeros(BUCKETS * CONTEXTS, np.int64)
            for texts in groups(batch.column(0).to_pylist(), GROUP_CHARS):
                own, at, sizes = words_of(texts)
                if not own:
                    continue
                bucket = np.array([bucket_of(w) for w in own])[at]
                context = np.array([zlib.crc32(w) % CONTEXTS for w in own])[at]
                inside = np.ones(len(at), bool)
                ends = np.cumsum(sizes)
                inside[ends[ends < len(at)]] = False
                inside[0] = False
                cells += np.bincount(bucket[inside] * CONTEXTS + context[np.flatnonzero(inside) - 1], minlength=len(cells))
                for w, n in zip(own, np.bincount(at).tolist(), strict=True):
                    words[w] = words.get(w, 0) + n
            some = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*words, *[None] * len(some)], pa.binary()),
                    pa.array([*[None] * len(words), *some.tolist()], pa.int64()),
                    pa.array([*words.values(), *cells[some].tolist()], pa.int64()),
                ],
                ["word", "cell", "n"],
            )

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, cell bigint, n bigint")
    return stage(rows.groupBy("word", "cell").agg(F.sum("n").alias("n")), "counts")


def cluster(cells: np.ndarray, seed: int = 8, rounds: int = 15) -> np.ndarray:
    """Class (1 and up) of every bucket: weighted k-means over what comes before, on square roots of shares."""
    total = cells.sum(1)
    used = np.flatnonzero(total)
    out = np.ones(BUCKETS, np.int64)
    if len(used) == 0:
        return out
    x = np.sqrt(cells[used] / total[used, None])
    weight = np.sqrt(total[used].astype(float))
    centers = x[np.argsort(-weight, kind="stable")[: CLASSES - 1]].copy()
    for _ in range(rounds):
        near = (x @ centers.T - 0.5 * (centers**2).sum(1)).argmax(1)
        for k in range(len(centers)):
            if (mine := near == k).any():
                centers[k] = np.average(x[mine], axis=0, weights=weight[mine])
    out[used] = near + 1
    return out


@dataclass
class Language:
    """What scoring needs besides the table of all counts; of bounded size."""

    classes: np.ndarray  # of buckets
    class_log: np.ndarray  # log10 of the normaliser of each class
    frequent: dict[bytes, float]  # log10 (count + 0.5)
    n: int
    v: int
    documents: int
    rows: int  # of the weights
    weights: np.ndarray | None = None  # [rows, CLASSES]
    bias: np.ndarray | None = None

    def zero(self) -> None:
        self.weights, self.bias = np.zeros((self.rows, CLASSES), np.float32), np.zeros(CLASSES, np.float32)

    def features(self, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """``[4, tokens]`` rows of the weights; ``place`` counts the tokens before one in its text."""
        before = []
        for k in (1, 2, 3):
            h = np.concatenate([np.zeros(min(k, len(hashes)), np.uint64), hashes[:-k]])
            before.append(np.where(place >= k, h, np.uint64(k)))
        one, two, three = before
        with np.errstate(over="ignore"):
            keys = [one * PRIMES[0], (one * PRIMES[1]) ^ (two * PRIMES[2]), two * PRIMES[3], three * PRIMES[2] + PRIMES[0]]
            spare = np.uint64(65 - self.rows.bit_length())  # bits of a hash that a row's number does not need
            return np.stack([((k ^ (k >> np.uint64(29))) * PRIMES[1] >> spare).astype(np.int64) for k in keys])

    def tokens(self, texts: list[str | None]):
        """Hashes, classes and places of all tokens, each text closed by its end; also words and sizes."""
        own, at, sizes = words_of(texts)
        sizes = sizes + 1
        ends = np.cumsum(sizes) - 1
        is_word = np.ones(int(sizes.sum()), bool)
        is_word[ends] = False
        hashes, classes = np.zeros(len(is_word), np.uint64), np.zeros(len(is_word), np.int64)
        if own:
            hashes[is_word] = np.array([xxhash.xxh64_intdigest(w) for w in own], np.uint64)[at]
            classes[is_word] = self.classes[np.array([bucket_of(w) for w in own])][at]
        place = np.arange(len(is_word)) - np.repeat(ends - sizes + 1, sizes)
        return hashes, classes, place, ends, sizes, is_word, own, at

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = self.weights.take(rows[0], axis=0)
        for r in rows[1:]:
            out += self.weights.take(r, axis=0)
        out += self.bias
        return out

    def class_scores(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of each token's class given what comes before."""
        out = np.zeros(len(classes))
        for lo in range(0, len(classes), BATCH):
            z, own = self.logits(rows[:, lo : lo + BATCH]), classes[lo : lo + BATCH]
            z -= z.max(1, keepdims=True)
            out[lo : lo + BATCH] = z[np.arange(len(own)), own] - np.log(np.exp(z).sum(1))
        return out / np.log(10)


def sums_by_row(rows: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``rows`` (``[families, tokens]``) and, for each, the sum of its tokens' slopes.

    Tokens are sorted by row. The first LAYERS tokens of all rows are added together,
    the rest of the few rows that have more on their own.
    """
    key = np.sort((rows * BATCH + np.arange(rows.shape[1])).ravel())
    row, token = key // BATCH, key % BATCH
    first = np.flatnonzero(np.diff(row, prepend=-1))
    sizes = np.diff(first, append=len(row))
    falling = np.argsort(-sizes, kind="stable")
    first, sizes = first[falling], sizes[falling]
    sums = slope.take(token[first], axis=0)
    more = np.searchsorted(-sizes, -np.arange(1, LAYERS + 1))  # rows with over 1, 2, ... tokens
    for k in range(1, LAYERS):
        n = more[k - 1]
        sums[:n] += slope.take(token[first[:n] + k], axis=0)
    for i in range(more[-1]):
        sums[i] += slope.take(token[first[i] + LAYERS : first[i] + sizes[i]], axis=0).sum(0)
    return row[first], sums


class Learner:
    """Adaptive gradient ascent on the log-likelihood of classes."""

    def __init__(self, language: Language) -> None:
        self.m = language
        language.zero()
        self.seen = np.full(language.rows, 1e-3, np.float32)  # squared gradients of a row of weights
        self.seen_bias = np.full(CLASSES, 1e-3, np.float32)
        self.tokens = 0

    def learn(self, rows: np.ndarray, classes: np.ndarray) -> None:
        for lo in range(0, len(classes), BATCH):
            part, own = rows[:, lo : lo + BATCH], classes[lo : lo + BATCH]
            z = self.m.logits(part)
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z /= -z.sum(1, keepdims=True)
            z[np.arange(len(own)), own] += 1  # the slopes
            which, sums = sums_by_row(part, z)
            seen = self.seen[which] + np.einsum("ij,ij->i", sums, sums)
            self.seen[which] = seen
            sums *= (RATE / np.sqrt(seen))[:, None]
            sums += self.m.weights.take(which, axis=0)
            self.m.weights[which] = sums
            sums = z.sum(0)
            self.seen_bias += sums * sums
            self.m.bias += RATE * sums / np.sqrt(self.seen_bias)
            self.tokens += len(own)


def fit_weights(docs: DataFrame, language: Language, text_col: str) -> None:
    """One pass of gradient updates over all of ``docs``, task by task, then the mean of the tasks' weights."""
    size = PIECE * CLASSES
    n = language.rows // PIECE

    def run(batches):
        learner = Learner(Language(**vars(language)))
        for batch in batches:
            for texts in groups(batch.column(0).to_pylist(), GROUP_CHARS):
                hashes, classes, place, *_ = learner.m.tokens(texts)
                learner.learn(learner.m.features(hashes, place), classes)
        if learner.tokens:
            pieces = [*learner.m.weights.reshape(n, size), learner.m.bias]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n + 1), pa.int64()), pa.array([learner.tokens] * (n + 1), pa.int64()), pa.array([p.astype("<f2").tobytes() for p in pieces], pa.binary())],
                ["piece", "tokens", "data"],
            )

    def mean_of(kind):
        def run(key, found):
            tokens = found.column("tokens").to_numpy().astype(np.float64)
            data = np.stack([np.frombuffer(d, kind) for d in found.column("data").to_pylist()])
            out = (tokens @ data / tokens.sum()).astype("<f4")
            return pa.table({"piece": [key[0].as_py()], "task": [key[1].as_py()], "tokens": [int(tokens.sum())], "data": pa.array([out.tobytes()], pa.binary())})

        return run

    # a task's weights travel once, as halves: rounding is far below what tasks differ by
    trained = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "piece bigint, tokens bigint, data binary")
    found = trained.select("piece", F.spark_partition_id().cast("long").alias("task"), "tokens", "data")
    for level in range(LEVELS):
        nearer = found.withColumn("task", F.expr(f"task div {FAN_IN}"))
        found = nearer.groupBy("piece", "task").applyInArrow(mean_of("<f4" if level else "<f2"), "piece bigint, task bigint, tokens bigint, data binary")
    language.zero()
    for r in found.collect():  # one model: at most MAX_ROWS rows
        data = np.frombuffer(bytes(r["data"]), "<f4")
        if r["piece"] == n:
            language.bias[:] = data
        else:
            language.weights.reshape(n, size)[r["piece"]] = data


def learn(df: DataFrame, text_col: str = "text", frequent: int = FREQUENT) -> tuple[Language, DataFrame]:
    """The model and the table ``word, c`` of all counts. Null texts are empty texts: just their end."""
    docs = df.count()
    rows = count_rows(df, text_col)
    counts = rows.where(F.col("word").isNotNull()).select("word", F.col("n").alias("c"))
    cells = np.zeros(BUCKETS * CONTEXTS, np.int64)
    for r in rows.where(F.col("word").isNull()).select("cell", "n").collect():  # at most BUCKETS * CONTEXTS
        cells[r["cell"]] = r["n"]
    classes = cluster(cells.reshape(BUCKETS, CONTEXTS))
    last = F.expr("substring(word, -3, 3)")
    per_bucket = counts.groupBy((F.crc32(F.when(F.length("word") < 3, F.col("word")).otherwise(last)) % BUCKETS).alias("b")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")
    )
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_bucket.collect():  # at most BUCKETS
        n[classes[r["b"]]] += r["n"]
        v[classes[r["b"]]] += r["v"]
    n[0], v[0] = docs, min(docs, 1)
    # one row a distinct count: the lowest count down to which there are at most ``frequent`` words
    falling = Window.orderBy(F.desc("c"))
    levels = counts.groupBy("c").agg(F.count(F.lit(1)).alias("words")).withColumn("above", F.sum("words").over(falling))
    edge = levels.where(F.col("above") <= frequent).agg(F.min("c")).first()[0]
    top = [] if edge is None else counts.where(F.col("c") >= edge).collect()
    known = {bytes(r["word"]): float(np.log10(r["c"] + 0.5)) for r in top}
    language = Language(classes, np.log10(n + 0.5 * (v + 1)), known, int(n.sum()), int(v.sum()), docs, rows_for(int(n.sum())))
    fit_weights(df, language, text_col)
    return language, counts


def scores(df: DataFrame, language: Language, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A null or empty text is scored for its end alone. Equal or null ids stay rows of
    their own; other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    end_log = float(np.log10(language.documents + 0.5))

    def run(batches):
        for batch in batches:
            key, ids = batch.column(0).to_numpy(), batch.column(1)
            at_row = 0
            for texts in groups(batch.column(2).to_pylist(), GROUP_CHARS):
                hashes, classes, place, ends, sizes, is_word, own, at = language.tokens(texts)
                gain = language.class_scores(language.features(hashes, place), classes) - language.class_log[classes]
                value = np.array([language.frequent.get(w, np.nan) for w in own] or [np.nan])
                word_value = np.full(len(is_word), end_log)
                word_value[is_word] = value[at]
                rare = np.isnan(word_value)
                starts = ends - sizes + 1
                summed = np.add.reduceat(np.where(rare, 0.0, word_value), starts)
                known = np.add.reduceat((~rare).astype(np.int64), starts)
                if not language.documents:
                    known -= 1  # the end was never seen
                model = np.add.reduceat(gain, starts)
                rows = key[at_row : at_row + len(texts)]
                # words to be joined: one row for each text and rare word
                text_of = np.repeat(np.arange(len(texts)), sizes)[is_word]
                odd = np.flatnonzero(rare[is_word])
                pair, times = np.unique(text_of[odd] * max(len(own), 1) + at[odd], return_counts=True)
                n = len(pair)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, rows[pair // max(len(own), 1)]])),
                        pa.concat_arrays([_flat(ids.slice(at_row, len(texts))), pa.nulls(n, ids.type)]),
                        pa.array(np.concatenate([sizes, times])),
                        pa.array(np.concatenate([known, np.zeros(n, np.int64)])),
                        pa.array(np.concatenate([summed, np.zeros(n)])),
                        pa.array(np.concatenate([model, np.zeros(n)])),
                        pa.array([None] * len(texts) + [own[i] for i in (pair % max(len(own), 1)).tolist()], pa.binary()),
                    ],
                    ["row", "doc_id", "n", "known", "summed", "model", "word"],
                )
                at_row += len(texts)

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = stage(rows.mapInArrow(run, f"row bigint, doc_id {kind}, n bigint, known bigint, summed double, model double, word binary"), "scored")
    rare = found.where(F.col("word").isNotNull()).select(F.col("row").alias("r"), F.col("n").alias("times"), F.col("word").alias("w"))
    joined = rare.join(counts, rare.w == counts.word, "left")
    c = F.coalesce("c", F.lit(0))
    per_row = joined.groupBy("r").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    whole = found.where(F.col("word").isNull()).join(per_row, F.col("row") == F.col("r"), "left")
    logs = F.col("summed") + F.coalesce("more", F.lit(0.0))
    spread = float(np.log10(language.n + 0.5 * (language.v + 1)))
    return whole.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(language.n).cast("long").alias("train_tokens"),
        (logs - F.col("n") * spread).alias("base_score"),
        (logs + F.col("model")).alias("score"),
    )


def _flat(ids) -> pa.Array:
    return ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    language, counts = learn(docs.where(~held_out()))
    out = scores(docs, language, counts)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
