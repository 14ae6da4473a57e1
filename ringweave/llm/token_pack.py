"""Token ids in fixed-width bit-packed files with random access.

Every id takes the fewest bits that hold the largest id of the vocabulary. A file is

    magic, header                    HEADER below
    block offsets   (blocks + 1) u8  where each block of BLOCK_IDS ids starts, in bytes from the data
    document starts (documents + 1) u8  first id of every document, counted in the file
    document ids    documents i8, then one byte each: 0 for a null id
    data            ids, least significant bit first, each block starting at a byte

Files are written in ascending document order by the tasks of a range-sorted job;
a task that runs again writes new files, and only the files named in the
manifest (a table) are read. A null or empty text is just its end id.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringweave.llm.common import Recent, documents, segments
from ringweave.session import shared_root, stage

MAGIC = b"RWIDPCK1"
HEADER = struct.Struct("<8sIIIQQQ")  # magic, bits, ids a block, vocabulary size, ids, documents, blocks
BLOCK_IDS = 4096
FILE_IDS = 1 << 25
END_ID = 1
#: characters of texts that are encoded together, and ids that a reader unpacks at once
GROUP_CHARS, READ_IDS = 1 << 18, 1 << 20
MEMO = 300_000
TAIL = ".,;:!?*#$%&|"
MARKS = frozenset(TAIL)


def width_of(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of one block side by side, ``bits`` each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Packer:
    """Collects documents and writes one file."""

    def __init__(self, vocab_size: int) -> None:
        self.vocab_size, self.bits = vocab_size, width_of(vocab_size)
        self.ids: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.total = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= self.vocab_size:
            raise ValueError("an id lies outside the vocabulary")
        self.ids.append(ids)
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.total += len(ids)

    def write(self, out) -> None:
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        self.ids = [flat]
        blocks = -(-self.total // BLOCK_IDS)
        full = (BLOCK_IDS * self.bits + 7) // 8
        last = ((self.total - (blocks - 1) * BLOCK_IDS) * self.bits + 7) // 8 if blocks else 0
        ends = np.arange(blocks + 1, dtype="<u8") * full
        if blocks:
            ends[-1] = (blocks - 1) * full + last
        out.write(HEADER.pack(MAGIC, self.bits, BLOCK_IDS, self.vocab_size, self.total, len(self.sizes), blocks))
        out.write(ends.tobytes())
        out.write(np.concatenate([[0], np.cumsum(self.sizes)]).astype("<u8").tobytes())
        out.write(np.array([k or 0 for k in self.keys], "<i8").tobytes())
        out.write(bytes(k is not None for k in self.keys))
        for i in range(0, self.total, BLOCK_IDS):
            out.write(pack(flat[i : i + BLOCK_IDS], self.bits))


class PackedFile:
    """Random access to one file: documents or ranges of ids."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        magic, self.bits, self.block, self.vocab_size, self.total, n_docs, blocks = HEADER.unpack(source.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        at = HEADER.size

        def array(kind: str, count: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * count
            got = np.frombuffer(source.read_at(size, at), kind, count)
            at += size
            return got

        self.offsets, self.starts = array("<u8", blocks + 1).astype(np.int64), array("<u8", n_docs + 1).astype(np.int64)
        keys, held = array("<i8", n_docs), array("u1", n_docs)
        self.keys = [k if h else None for k, h in zip(keys.tolist(), held.tolist(), strict=True)]
        self.data = at

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        lo, hi = int(self.offsets[first]), int(self.offsets[last + 1])
        raw = self.source.read_at(hi - lo, self.data + lo)
        if (self.block * self.bits) % 8 == 0:  # full blocks end at a byte: one run of bits
            got = unpack(raw, self.bits, min(self.total, (last + 1) * self.block) - first * self.block)
        else:
            parts = []
            for b in range(first, last + 1):
                a, z = int(self.offsets[b]) - lo, int(self.offsets[b + 1]) - lo
                parts.append(unpack(raw[a:z], self.bits, min(self.total, (b + 1) * self.block) - b * self.block))
            got = np.concatenate(parts)
        return got[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class SpacedEncoder:
    """The tokenizers library behind a memo of chunks.

    For vocabularies whose pre-tokens never hold white space, chunks between
    spaces are encoded on their own; ids are kept as bytes.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.ends_word = np.zeros(self.vocab_size, bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if token.endswith("</w>")]] = True
        self.memo, self.parts = Recent(MEMO), Recent(MEMO // 2)

    def learn(self, chunks: list[str]) -> None:
        """A chunk is its ids up to closing ASCII marks, then those of the marks: marks and letters never share a pre-token."""
        cut = [(c, "") if c[-1:] not in MARKS else (c[:n], c[n:]) if (n := len(c.rstrip(TAIL))) and c[n - 1].lower()[-1].isalpha() else (c, "") for c in chunks]
        wanted = set(chain.from_iterable(cut))
        self.parts.room(len(wanted))
        new = self.parts.missing(wanted)
        words = [p for p in new if p.isalpha()]
        self.learn_words(words)
        others = [p for p in new if not p.isalpha()] if len(words) < len(new) else []
        self.learn_parts(others)
        known, young = self.parts.young, self.memo.young
        for c, (a, b) in zip(chunks, cut, strict=True):
            young[c] = known[a] + known[b]

    def learn_parts(self, new: list[str]) -> None:
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.parts.young[p] = np.array(e.ids, self.kind).tobytes()

    def learn_words(self, new: list[str]) -> None:
        """Words in one text: every pre-token has one id that ends it, so as many such ids as words mean one pre-token a word."""
        for lo in range(0, len(new), 512):
            some = new[lo : lo + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            stops = (np.flatnonzero(self.ends_word[ids]) + 1) * self.kind.itemsize
            if len(stops) != len(some):
                self.learn_parts(some)
                continue
            data, young = ids.tobytes(), self.parts.young
            for p, a, z in zip(some, [0, *stops.tolist()], stops.tolist(), strict=False):
                young[p] = data[a:z]

    def encode(self, texts: list[str]) -> list[bytes]:
        plans = [t.replace("\n", " ").split(" ") for t in texts]
        wanted = set().union(*plans)
        self.memo.room(len(wanted))
        new = self.memo.missing(wanted)
        if new:
            self.learn(new)
        get = self.memo.young.__getitem__
        return [b"".join(map(get, p)) for p in plans]

    def whole(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; short texts are encoded together, long ones a segment at a time."""
        lo = 0
        while lo < len(texts):
            hi, chars = lo + 1, len(texts[lo] or "")
            if chars > GROUP_CHARS:
                yield self.ids(texts[lo])
            else:
                while hi < len(texts) and (chars := chars + len(texts[hi] or "")) <= GROUP_CHARS:
                    hi += 1
                for data in self.encode([t or "" for t in texts[lo:hi]]):
                    yield np.frombuffer(data, self.kind)
            lo = hi

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode([s])[0] for s in segments(text or "")), self.kind)


_LOADED: dict[str, SpacedEncoder] = {}


def loaded(spec: str) -> SpacedEncoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = SpacedEncoder(spec)
    return _LOADED[key]


def _file_system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", root))


def write_packed(df: DataFrame, spec: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text and write the files; returns the manifest ``(part, seq, path, n_docs, n_ids)``.

    Documents come in ascending id, nulls first; equal ids in the order of a hash
    of their text, then of the text. Equal rows each keep their own document.
    ``folder`` is any place pyarrow's file systems and Spark both reach. Other columns are left out.
    """
    fs, base = _file_system(folder)
    fs.create_dir(base, recursive=True)
    tie = F.xxhash64(F.col(text_col))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), tie.alias("tie"))
    rows = rows.repartitionByRange(rows.doc_id.asc_nulls_first(), rows.tie).sortWithinPartitions(rows.doc_id.asc_nulls_first(), "tie", "text")

    def run(batches):
        encoder = loaded(spec)
        fs, base = _file_system(folder)
        part, seq, out = TaskContext.get().partitionId(), 0, []
        packer = Packer(encoder.vocab_size)

        def flush():
            nonlocal packer, seq
            path = f"{base}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(path) as f:
                packer.write(f)
            out.append((part, seq, path, len(packer.sizes), packer.total))
            packer, seq = Packer(encoder.vocab_size), seq + 1

        end = np.array([end_id], encoder.kind)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder.whole(batch.column(1).to_pylist()), strict=True):
                packer.add(key, np.concatenate([ids, end]))
                if packer.total >= file_ids:
                    flush()
        if packer.sizes:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["part", "seq", "path", "n_docs", "n_ids"])

    return stage(rows.select("doc_id", "text").mapInArrow(run, "part bigint, seq bigint, path string, n_docs bigint, n_ids bigint"), "packed")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest (a row a file of tens of megabytes) with the ids before each file."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def checksums(file: PackedFile) -> list[int]:
    """crc32 of each document's ids as 32-bit integers, ``READ_IDS`` ids at a time."""
    crcs, lo, n_docs = [], 0, len(file.keys)
    while lo < n_docs:
        base = int(file.starts[lo])
        hi = max(lo + 1, int(np.searchsorted(file.starts, base + READ_IDS, "right")) - 1)
        if hi == lo + 1:  # perhaps a long one
            crc = 0
            for a in range(base, int(file.starts[hi]), READ_IDS):
                crc = zlib.crc32(file.ids(a, min(a + READ_IDS, int(file.starts[hi]))).astype("<u4").tobytes(), crc)
            crcs.append(crc)
        else:
            raw = memoryview(file.ids(base, int(file.starts[hi])).astype("<u4").tobytes())
            ends = ((file.starts[lo : hi + 1] - base) * 4).tolist()
            crcs += [zlib.crc32(raw[a:z]) for a, z in zip(ends, ends[1:], strict=False)]
        lo = hi
    return crcs


def read_packed(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(folder)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    file = PackedFile(source)
                    crcs = checksums(file)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.keys, pa.int64()), pa.array(file.starts[:-1] + before), pa.array(np.diff(file.starts)), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = max(1, manifest.count())
    return with_starts(manifest).select("path", "start").repartition(files, "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def vocabulary(path: str | None = None) -> str:
    """Text of the tokenizers file (1.7 MB), read on the driver and sent with the job."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_root(spark)}/packed-{uuid.uuid4().hex}"
    return read_packed(write_packed(documents(spark, sf_dir), vocabulary(), folder), folder)
