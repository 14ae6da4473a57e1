"""Language identification by Kneser-Ney character models.

Every language has an interpolated Kneser-Ney model over the characters of
words (runs of letters, lower case, one space on each side, so contexts stay
inside a word). All models share two sorted hash arrays: n-grams with a column of
final log-probabilities a language, and contexts with a column of back-off
weights a language, so one search serves all languages. A text gets the language
of the lowest cross-entropy per character, or is rejected if its entropy lies
above a limit, calibrated on held-back training texts by length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.llm.bpe import groups
from ringweave.llm.common import Recent, crc_of, documents, segments, tidy

ORDER = 5
SAMPLE = 2000  # training texts of a language, about; chosen by a hash over all of them
CALIBRATION = 8  # every eighth of them sets the rejection limit instead ...
ENOUGH = 16  # ... in languages with so many labelled texts
REJECTED = 0.999  # quantile of calibration texts that are accepted ...
SPARE_BITS = 2.5  # ... and this many bits a character on top: only text unlike any language goes
SHARP = 40.0  # characters after which a posterior gets no sharper
UNDECIDED = "und"
WORDS = regex.compile(r"\p{L}+")  # numerals and signs are no letters
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


@dataclass
class Encoded:
    """Characters of padded words behind each other; ``room`` counts the characters before one in its word."""

    codes: np.ndarray
    room: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Encoded:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        joined = "".join([f" {w} " for w in words])
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        return cls(codes, np.arange(len(codes)) - starts[owner], owner)

    def hashes(self, order: int = ORDER) -> list[np.ndarray]:
        """Hash of the n-gram that ends at each character, for n = 0 to ``order`` (where it fits its word)."""
        with np.errstate(over="ignore"):
            out = [np.zeros(len(self.codes), np.uint64)]
            for n in range(1, order + 1):
                before = np.concatenate([out[-1][:1] * 0, out[-1][:-1]])
                out.append((before + np.uint64(n)) * MULTIPLIER + self.codes + np.uint64(1))
        return out


def gram_rows(words: list[str], weights: list[int]) -> tuple[np.ndarray, ...]:
    """Distinct n-grams of weighted words: length, hash, hash without the last, hash without the first character, whether it opens a word, count."""
    text = Encoded.of(words)
    hashes, weight = text.hashes(), np.array(weights, np.int64)[text.owner]
    parts = []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(text.room >= max(n - 1, 1))  # the opening space is given, not predicted
        if not len(at):
            continue
        own, first, place = np.unique(hashes[n][at], return_index=True, return_inverse=True)
        some = at[first]
        parts.append(
            (np.full(len(own), n), own, hashes[n - 1][some - 1], hashes[n - 1][some], text.room[some] == n - 1, np.bincount(place, weight[at]).astype(np.int64))
        )
    if not parts:
        return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, np.uint64, bool, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray
    logs: np.ndarray  # [grams, langs] bits
    contexts: np.ndarray
    backoff: np.ndarray  # [contexts, langs] bits
    uniform: float
    limit: tuple[float, float] = (99.0, 0.0)  # bits a character: first + second / sqrt(characters)
    memo: Recent = field(default_factory=lambda: Recent(200_000))

    @staticmethod
    def fit(rows: dict[str, tuple[np.ndarray, ...]]) -> Model:
        """Tables from the n-gram rows of each language."""
        langs = sorted(rows)
        grams = np.unique(np.concatenate([r[1] for r in rows.values()] or [np.zeros(0, np.uint64)]))
        letters = len(np.unique(np.concatenate([r[1][r[0] == 1] for r in rows.values()] or [np.zeros(0, np.uint64)])))
        contexts = np.unique(np.concatenate([r[2] for r in rows.values()] or [np.zeros(0, np.uint64)]))
        uniform = -np.log2(letters + 1)
        model = Model(langs, grams, np.zeros((len(grams), len(langs)), np.float32), contexts, np.zeros((len(contexts), len(langs)), np.float32), uniform)
        size, lead, tail = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.uint64)
        for r in rows.values():
            at = np.searchsorted(grams, r[1])
            size[at], lead[at], tail[at] = r[0], r[2], r[3]
        for k, lang in enumerate(langs):
            n, own, ctx, rest, opens, count = rows[lang]
            # lower orders count the different characters before; a word's opening has none and keeps its count
            used = np.where((n == ORDER) | opens, count, 0)
            longer = n > 1
            target = np.searchsorted(own, rest[longer], sorter=(order := np.argsort(own)))
            np.add.at(used, order[np.minimum(target, len(own) - 1)], np.where(opens[order[np.minimum(target, len(own) - 1)]], 0, 1))
            used = np.where((n < ORDER) & ~opens, np.maximum(used, 1), used)
            at_ctx = np.searchsorted(contexts, ctx)
            total = np.bincount(at_ctx, used, len(contexts))
            kinds = np.bincount(at_ctx, minlength=len(contexts))
            cut = np.zeros(ORDER + 1)
            for o in range(1, ORDER + 1):
                one, two = ((used == 1) & (n == o)).sum(), ((used == 2) & (n == o)).sum()
                cut[o] = one / (one + 2 * two) if one and two else 0.5
            length = np.zeros(len(contexts), np.int64)
            length[at_ctx] = n
            weight = np.where(total > 0, cut[length] * kinds / np.maximum(total, 1), 1.0)
            model.backoff[:, k] = np.log2(weight)
            prob = np.zeros(len(grams))
            place = np.searchsorted(grams, own)
            direct = np.zeros(len(grams))
            direct[place] = np.maximum(used - cut[n], 0) / total[at_ctx]
            for o in range(1, ORDER + 1):  # shorter first: they are what longer ones fall back on
                at = np.flatnonzero(size == o)
                lower = 2.0**uniform if o == 1 else prob[np.searchsorted(grams, tail[at])]
                prob[at] = direct[at] + weight[np.searchsorted(contexts, lead[at])] * lower
            model.logs[:, k] = np.log2(prob)
        return model

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word in each language (negative), and its characters."""
        text = Encoded.of(words)
        hashes, total = text.hashes(), np.zeros((len(text.codes), len(self.langs)))
        todo = np.flatnonzero(text.room > 0)
        steps = np.bincount(text.owner[todo], minlength=len(words))
        for n in range(ORDER, 0, -1):
            here = todo[text.room[todo] >= n - 1]
            rest = todo[text.room[todo] < n - 1]
            at = np.minimum(np.searchsorted(self.grams, hashes[n][here]), len(self.grams) - 1)
            hit = self.grams[at] == hashes[n][here]
            total[here[hit]] += self.logs[at[hit]]
            missed = here[~hit]
            ctx = hashes[n - 1][missed - 1]
            at = np.minimum(np.searchsorted(self.contexts, ctx), len(self.contexts) - 1)
            known = self.contexts[at] == ctx
            total[missed[known]] += self.backoff[at[known]]
            todo = np.concatenate([missed, rest])
        total[todo] += self.uniform
        return np.add.reduceat(total, np.flatnonzero(text.room == 0)), steps

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text in each language, and its characters (0: no letters)."""
        split = [words_of(t) for t in texts]
        wanted = set().union(*split)
        self.memo.room(len(wanted))
        new = self.memo.missing(wanted)
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            bits, steps = self.score_words(some)
            for w, row in zip(some, np.column_stack([steps, bits]).astype(np.float32), strict=True):
                self.memo.young[w] = row.tobytes()
        get, width = self.memo.young.__getitem__, 1 + len(self.langs)
        sums = np.zeros((len(texts), width))
        for i, words in enumerate(split):
            if words:
                sums[i] = np.frombuffer(b"".join(map(get, words)), np.float32).reshape(-1, width).sum(0, dtype=np.float64)
        n = sums[:, 0]
        return -sums[:, 1:] / np.maximum(n, 1)[:, None], n

    def text_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Whole texts of any length, a bounded stretch at a time."""
        if sum(len(t or "") for t in texts) <= 1 << 21:
            return self.entropies([t or "" for t in texts])
        rows, sizes = [], []
        for t in texts:
            parts = [self.entropies([s]) for s in segments(t or "")]
            n = sum(p[1][0] for p in parts)
            rows.append(sum(p[0][0] * p[1][0] for p in parts) / max(n, 1))
            sizes.append(n)
        return np.array(rows), np.array(sizes)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return [(UNDECIDED, 0.0, True)] * len(texts)
        bits, n = self.text_entropies(texts)
        best = bits.argmin(1)
        low = bits[np.arange(len(texts)), best]
        limit = self.limit[0] + self.limit[1] / np.sqrt(np.maximum(n, 1))
        all_bits = np.column_stack([bits, limit])
        lead = np.exp2(-(all_bits - low[:, None]) * np.minimum(n, SHARP)[:, None])
        score = 1.0 / lead.sum(1)
        return [
            (self.langs[b], float(s), bool(r)) if k else (UNDECIDED, 0.0, True) for b, s, r, k in zip(best, score, low > limit, n > 0, strict=True)
        ]


def _words_table(sample: DataFrame) -> DataFrame:
    """Distinct words of the training texts with their counts, ``lang, word, n``."""

    def run(batches):
        for batch in batches:
            lang, word = [], []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words_of(text or "")
                lang += [one] * len(found)
                word += found
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string())], ["lang", "word"])

    return sample.mapInArrow(tidy(run), "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def train(df: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit the models on about ``sample`` labelled texts a language, chosen by a hash over all rows.

    The sample bounds what reaches the driver: its distinct words. Rows without
    language or text teach nothing; without any rows the model knows no language.
    Languages of fewer than ENOUGH texts, or with most of their rows in the part that
    would be held back (repeated rows), learn from all of them; if all are such,
    only texts without letters are rejected.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col)).alias("h")
    )
    hold = F.pmod(F.shiftright("h", 20), F.lit(CALIBRATION)) == 0
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~hold, 1)).alias("free")).collect()
    sizes = {r["lang"]: r["n"] for r in counted}
    if not sizes:
        return Model.fit({})
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / v)))])
    spot = F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003
    chosen = rows.where(spot < share[F.col("lang")])
    splits = F.create_map(*[x for r in counted for x in (F.lit(r["lang"]), F.lit(r["n"] >= ENOUGH and 2 * r["free"] >= r["n"]))])
    hold = hold & splits[F.col("lang")]
    found: dict[str, tuple[list, list]] = {}
    for r in _words_table(chosen.where(~hold).select("lang", "text")).toLocalIterator():
        own = found.setdefault(r["lang"], ([], []))
        own[0].append(r["word"])
        own[1].append(r["n"])
    model = Model.fit({k: gram_rows(*v) for k, v in found.items()})
    if not model.langs:
        return model

    def measure(batches):
        for batch in batches:
            for texts in groups(batch.column(1).to_pylist()):
                bits, n = model.text_entropies(texts)
                yield pa.RecordBatch.from_arrays([pa.array(bits.min(1)), pa.array(n)], ["bits", "n"])

    held = chosen.where(hold).select("lang", "text").mapInArrow(tidy(measure), "bits double, n double").where("n > 0").toPandas()
    if len(held):
        mean = float(np.average(held.bits, weights=held.n))
        spread = float(np.quantile((held.bits - mean) * np.sqrt(held.n), REJECTED))
        model.limit = (mean + SPARE_BITS, max(spread, 3.0))
    return model


def predictions(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    A null text or one without letters is ``und``, score 0, rejected. Only the text decides.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    model = Model(model.langs, model.grams, model.logs, model.contexts, model.backoff, model.uniform, model.limit)

    def run(batches):
        for batch in batches:
            out: list[tuple[str, float, bool]] = []
            for texts in groups(batch.column(0).to_pylist()):
                out += model.predict(texts)
            cols = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*keep, "lang_pred", "score", "rejected"])

    rows = df.select(F.col(text_col).cast("string").alias("_text"), *keep)
    return rows.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return crc_of(F.col(id_col)) % 3 == 1


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predictions(docs, train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
