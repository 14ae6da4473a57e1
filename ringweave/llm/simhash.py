"""Near copies by SimHash, linked through Golay-code keys.

Two 64-bit fingerprints link at MOST_BITS or fewer differing bits. A fingerprint
has four segments of 16 bits, so at four errors either

* two segments agree exactly (keys of two exact segments), or
* one agrees and two of the other three differ in one bit at most (an exact
  segment with a fuzzy one), or
* all four differ in exactly one bit (two fuzzy segments).

A fuzzy segment is read as a word of the perfect binary Golay code (23, 12, 7):
its keys are the indices of the nearest codewords. Words one bit apart always
have the nearest codeword of the one among the keys of the other. So one side of
a join carries the nearest index and the other all of them; every candidate is
verified.

Only distinct fingerprints are compared. Groups of near copies are first
contracted around the smallest fingerprint of each exact key, and later joins give
only links between different groups: links grow with the fingerprints, not
with the pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.llm.bpe import groups
from ringweave.llm.common import components, documents, tidy
from ringweave.session import stage

SHINGLE, SEED, MOST_BITS = 4, 42, 4
SEGMENTS, SEGMENT_BITS = 4, 16
# fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code
GOLAY = 0b110001110101
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        spans = zip(starts[i : min(n, i + CHUNK)].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(data[a:z], seed) for a, z in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (and the columns of ``keep``); ``fp`` is the fingerprint as a signed long.

    Texts that are null, empty or white space have fingerprint 0. Rows with
    equal or null ids stay rows of their own. Other columns are left out.
    """
    kept = [c for c in keep if c not in (id_col, text_col)]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *kept)
    if not keep:
        schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, fp bigint"
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", fp bigint"

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, shingle) for some in groups(batch.column(1).to_pylist()) for t in some]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*batch.schema.names, "fp"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return rows.mapInArrow(tidy(run), schema)


def golay_words() -> np.ndarray:
    """The 4096 codewords by index: 12 data bits, then the remainder by GOLAY."""
    data = np.arange(4096, dtype=np.int64) << 11
    rest = data.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return data | rest


def golay_keys(bits: int = SEGMENT_BITS) -> np.ndarray:
    """``[2**bits, 6]`` codeword indices of every short word: the nearest first, then, if that is
    three errors away, the five that are four away; -1 fills up."""
    words = golay_words().astype(np.uint32)
    table = np.full((1 << bits, 6), -1, np.int16)
    for lo in range(0, 1 << bits, 1024):
        value = np.arange(lo, min(lo + 1024, 1 << bits), dtype=np.uint32)
        far = np.bitwise_count(value[:, None] ^ words[None, :])
        near = far.argmin(1)
        table[value, 0] = near
        hard = np.flatnonzero(far[np.arange(len(value)), near] == 3)
        row, index = np.nonzero(far[hard] == 4)
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(hard)))[row]
        table[value[hard][row], place + 1] = index
    return table


def exact_keys(fp: Column) -> Column:
    """Array of keys of two exact segments each."""
    part = [F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit(0xFFFF)) for i in range(SEGMENTS)]
    pairs = [(i, j) for i in range(SEGMENTS) for j in range(i)]
    return F.array(*[F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(part[i], 16) + part[j] for n, (i, j) in enumerate(pairs)])


#: (exact segment, fuzzy segment): for each exact one, two of the other three
MIXED = [(i, j) for i in range(SEGMENTS) for j in [k for k in range(SEGMENTS) if k != i][:2]]


def fuzzy_rows(fps: DataFrame, every: bool, table: np.ndarray) -> DataFrame:
    """``key, fp, root``: fuzzy keys of ``fps(fp, root)`` with all indices, or with the nearest only."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                fp, root = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                part = [(fp.view(np.uint64) >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF for i in range(SEGMENTS)]
                index = [table[p][:, : 6 if every else 1].astype(np.int64) for p in part]
                keys, rows = [], []
                for n, (i, j) in enumerate(MIXED):
                    key = (np.int64(n) << 32) + (part[i][:, None] << 12) + index[j]
                    r, c = np.nonzero(index[j] >= 0)
                    keys.append(key[r, c])
                    rows.append(r)
                both = (index[0][:, :, None] >= 0) & (index[1][:, None, :] >= 0)
                r, a, b = np.nonzero(both)
                keys.append((np.int64(len(MIXED)) << 32) + (index[0][r, a] << 12) + index[1][r, b])
                rows.append(r)
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp[at]), pa.array(root[at])], ["key", "fp", "root"])

    return fps.select("fp", "root").mapInArrow(tidy(run), "key bigint, fp bigint, root bigint")


def _near(a: Column, b: Column, most: int = MOST_BITS) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def _across(left: DataFrame, right: DataFrame) -> DataFrame:
    """Verified links between different groups.

    Spark sizes both sides by the fingerprints, without the keys that each gets (six
    exact, about seventy fuzzy), and would broadcast hundreds of MB: they are sorted.
    """
    a, b = left.hint("merge").alias("l"), right.alias("r")
    near = _near(F.col("l.fp"), F.col("r.fp")) & (F.col("l.root") != F.col("r.root"))
    return a.join(b, (F.col("l.key") == F.col("r.key")) & near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def roots(distinct: DataFrame) -> DataFrame:
    """``fp, root`` of distinct fingerprints: equal roots where links lead from one to the other."""
    keyed = stage(distinct.select("fp", F.explode(exact_keys(F.col("fp"))).alias("key")), "keyed")
    pivots = keyed.groupBy(F.col("key").alias("k")).agg(F.min("fp").alias("pivot"))
    star = keyed.join(pivots, (keyed.key == pivots.k) & (keyed.fp != pivots.pivot) & _near(keyed.fp, pivots.pivot))
    stars = stage(star.select(F.col("fp").alias("a"), F.col("pivot").alias("b")), "stars")

    def labelled(edges: DataFrame) -> DataFrame:
        found = components(edges)
        return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))

    first = stage(labelled(stars), "contracted")
    exact = first.select("fp", "root", F.explode(exact_keys(F.col("fp"))).alias("key"))
    table = golay_keys()
    links = _across(exact, exact).union(_across(fuzzy_rows(first, False, table), fuzzy_rows(first, True, table)))
    return labelled(stars.union(stage(links, "across")))


def grouped(prints: DataFrame) -> DataFrame:
    """``prints(doc_id, fp, ...)``, a written table, with ``root`` and ``component_id``, the smallest id of the group (null if it has none)."""
    own = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = roots(own.select("fp"))
    rooted = stage(found.join(own, "fp").select("fp", "root", "least"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("f"), "root", "component_id")
    return prints.join(named, prints.fp == named.f).drop("f")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; an empty table gives no rows."""
    prints = stage(fingerprints(df, id_col, text_col), "prints")
    return grouped(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, shingle: int = 5) -> DataFrame:
    """Documents without their near copies: of each group the row of the smallest id stays, and of rows with that id one.

    Copies are fingerprints of ``shingle``-word shingles that link as in ``near_duplicates``.
    """
    words = F.xxhash64(F.col("text").cast("string"))
    prints = stage(fingerprints(df.withColumn("_words", words), keep=("_words",), shingle=shingle).select("doc_id", "fp", "_words"), "prints")
    found = grouped(prints)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "_words")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("keep_id"), F.col("best._words").alias("keep_words"))
    # id and text name a row; texts are read again instead of written with their fingerprints
    rows = df.withColumn("_words", words)
    kept = rows.join(best, rows.doc_id.eqNullSafe(best.keep_id) & (rows["_words"] == best.keep_words), "left_semi")
    return kept.dropDuplicates(["doc_id", "_words"]).select(*df.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
