"""Byte-level BPE by speculation: propose longest matches, verify, mend.

A pre-token is first cut greedily into its longest vocabulary entries. That
proposal is the exact encoding if no merge crosses any boundary of it before the
merges that make the two neighbours; all neighbouring pairs of a batch are
tested together in numpy. Only pre-tokens with a failing pair are merged
pair by pair. Distinct pre-tokens are encoded once per task and kept in a
bounded memo.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ringweave.llm.common import Recent, documents, segments, tidy

# fixed value: the published pre-token pattern of byte-level BPE
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(2**62)
MEMO = 300_000
GROUP_CHARS = 1 << 20
SHORT, SIDE_BY_SIDE = 64, 8192


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else the next code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Tables of one vocabulary, read from the text of a tokenizers file."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, kind = data["model"], data.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or data.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        raw = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        specials = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = 1 + max([*raw, *specials.values()])
        self.text = [raw.get(i, b"") for i in range(size)]
        for content, i in specials.items():
            self.text[i] = content.encode()
        self.number = [str(i) for i in range(size)]
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.byte_id = np.full(256, -1, np.int64)
        for i, b in raw.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            if self.made[whole] >= 0:
                raise ValueError(f"two merges make token {whole}")
            if self.made[a] >= rank or self.made[b] >= rank:
                raise ValueError(f"merge {rank} comes before its parts")
            self.left[whole], self.right[whole], self.made[whole] = a, b, rank
            pairs[a, b] = rank, whole
        self.pairs, self.size = pairs, size
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.wholes = np.array(list(pairs.values()), np.int64).reshape(-1, 2)[order].T.copy()
        # only entries whose own encoding is themselves may be proposed
        ids = np.flatnonzero(self.made >= 0)
        sound = np.zeros(size, bool)
        sound[self.byte_id] = True
        fits = ~self.crossed(self.left[ids], self.right[ids], self.made[ids])
        for i, ok in sorted(zip(ids.tolist(), fits.tolist(), strict=True), key=lambda x: self.made[x[0]]):
            sound[i] = ok and sound[self.left[i]] and sound[self.right[i]]
        self.entry = {self.text[i]: i for i in np.flatnonzero(sound).tolist()}
        self.longest: dict[bytes, int] = {}  # by the first three bytes
        for b in self.entry:
            self.longest[b[:3]] = max(self.longest.get(b[:3], 0), len(b))
        self.pretoken = regex.compile(PRETOKEN)
        self.memo = Recent(MEMO)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NEVER)
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NEVER)

    def whole_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token made by a merge that is known to exist."""
        return self.wholes[np.searchsorted(self.keys, a * self.size + b)]

    def crossed(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge joins the end of ``a`` to the start of ``b`` (earlier than rank ``before``).

        Going back in time, the later made of the two neighbours is taken apart;
        while a pair stood side by side its merge must not have been due. Of equal
        merges the left one goes first.
        """
        bad = np.zeros(len(a), bool)
        todo = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        while len(todo):
            hit = self.rank_of(x, y) < limit
            bad[todo[hit]] = True
            mx, my = self.made[x], self.made[y]
            go = ~hit & ((mx >= 0) | (my >= 0))
            todo, x, y, mx, my = todo[go], x[go], y[go], mx[go], my[go]
            split_left = mx > my
            limit = np.where(split_left, mx, my + 1)
            x, y = np.where(split_left, self.right[x], x), np.where(split_left, y, self.left[y])
        return bad

    def propose(self, piece: bytes) -> list[int]:
        entry, longest, end = self.entry, self.longest, len(piece)
        if piece in entry:
            return [entry[piece]]
        out, at = [], 0
        while at < end:
            stop = min(end, at + longest.get(piece[at : at + 3], 2))
            while (found := entry.get(piece[at:stop])) is None:
                stop -= 1
            out.append(found)
            at = stop
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Exact merging of one long pre-token: a heap of due pairs over linked positions."""
        tok, pairs = [int(self.byte_id[b]) for b in piece], self.pairs
        after, before = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap = [(pairs[p][0], i, p) for i, p in enumerate(pairwise(tok)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= len(tok) or (tok[i], tok[j]) != pair:
                continue
            tok[i], tok[j] = pairs[pair][1], -1
            after[i] = k = after[j]
            if k < len(tok):
                before[k] = i
                if (new := (tok[i], tok[k])) in pairs:
                    heapq.heappush(heap, (pairs[new][0], i, new))
            if (h := before[i]) >= 0 and (new := (tok[h], tok[i])) in pairs:
                heapq.heappush(heap, (pairs[new][0], h, new))
        return [t for t in tok if t >= 0]

    def merge_short(self, pieces: list[bytes]) -> list[list[int]]:
        """Exact merging of many short pre-tokens side by side: each round makes the first due merge of every row."""
        width = max(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        held = np.arange(width) < sizes[:, None]
        tok = np.full((len(pieces), width + 1), -1, np.int64)
        tok[:, :width][held] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), NEVER)
        left, right = tok[:, :-1], tok[:, 1:]
        some = right >= 0
        rank[some] = self.rank_of(left[some], right[some])
        after = np.tile(np.arange(1, width + 1), (len(pieces), 1))
        before = np.tile(np.arange(-1, width - 1), (len(pieces), 1))
        row = np.arange(len(pieces))
        while len(row):
            i = rank[row].argmin(1)
            due = rank[row, i] < NEVER
            row, i = row[due], i[due]
            j = after[row, i]
            tok[row, i] = self.whole_of(tok[row, i], tok[row, j])
            rank[row, j] = NEVER
            k = after[row, j]
            tok[row, j] = -1
            after[row, i] = k
            inner = k < width
            before[row[inner], k[inner]] = i[inner]
            rank[row, i] = np.where(tok[row, k] >= 0, self.rank_of(tok[row, i], tok[row, k]), NEVER)
            h = before[row, i]
            has = h >= 0
            rank[row[has], h[has]] = self.rank_of(tok[row[has], h[has]], tok[row[has], i[has]])
        flat, kept = tok[tok >= 0], (tok >= 0).sum(1)
        ends = np.cumsum(kept)
        flat = flat.tolist()
        return [flat[e - n : e] for e, n in zip(ends.tolist(), kept.tolist(), strict=True)]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Exact ids of distinct pre-tokens: one numpy test for all neighbouring pairs."""
        guesses = [self.propose(p) for p in pieces]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        ids = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        if len(ids) > 1:
            owner = np.repeat(np.arange(len(sizes)), sizes)
            inside = owner[:-1] == owner[1:]
            pair, place = np.unique(ids[:-1][inside] * self.size + ids[1:][inside], return_inverse=True)
            wrong = self.crossed(pair // self.size, pair % self.size)[place]
            failed = np.unique(owner[:-1][inside][wrong]).tolist()
            failed.sort(key=lambda i: len(pieces[i]))
            short = [i for i in failed if len(pieces[i]) <= SHORT]
            for some in (short[n : n + SIDE_BY_SIDE] for n in range(0, len(short), SIDE_BY_SIDE)):
                for i, exact in zip(some, self.merge_short([pieces[i] for i in some]), strict=True):
                    guesses[i] = exact
            for i in failed[len(short) :]:
                guesses[i] = self.merge(pieces[i])
        return guesses

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of new chunks into the memo."""
        split = [self.pretoken.findall(c) for c in chunks]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        ids = dict(zip(words, self.encode_pieces([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        for c, parts in zip(chunks, split, strict=True):
            self.memo.young[c] = array("i", ids[parts[0]] if len(parts) == 1 else [i for p in parts for i in ids[p]]).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of every text, as bytes."""
        plans = [self._chunks(t) for t in texts]
        wanted = {c for c in set().union(*plans) if c.__class__ is str}
        self.memo.room(len(wanted))
        new = self.memo.missing(wanted)
        if new:
            self.learn(new)
        known = self.memo.young
        return [b"".join([known[c] if c.__class__ is str else c for c in plan]) for plan in plans]

    def _chunks(self, text: str) -> list:
        """Chunks that are encoded alone, and the ids of special strings in between."""
        if self.special and self.special.search(text):
            out: list = []
            for part in self.special.split(text):
                if part in self.specials:
                    out.append(np.int32(self.specials[part]).tobytes())
                elif part:
                    out += _spaced(part)
            return out
        return _spaced(text) if text else []


_RUN = regex.compile(r"\s (?:\s|$)")
_SLOW = regex.compile(r"\S+(?: (?=\S)|\s+)?|\s+")


def _spaced(text: str) -> list[str]:
    """Chunks that start at a space followed or preceded by something else than a space."""
    if _RUN.search(text):
        return regex.split(r"(?=(?<=\S) (?=\S))", text, flags=regex.V1)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + r for r in rest]


_LOADED: dict[str, ByteBpe] = {}


def loaded(spec: str) -> ByteBpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(spec)
    return _LOADED[key]


def ids_of(bpe: ByteBpe, text: str | None) -> Iterator[np.ndarray]:
    """Ids of one text, segment by segment."""
    for part in segments(text or ""):
        yield np.frombuffer(bpe.encode_many([part])[0], np.int32)


def decode(bpe: ByteBpe, ids: Iterable[int]) -> str:
    return b"".join(map(bpe.text.__getitem__, ids)).decode("utf-8", "replace")


def groups(texts: list[str | None], size: int = GROUP_CHARS) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``size`` characters together."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t or "")
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def encoded(bpe: ByteBpe, texts: list[str | None]) -> Iterator[np.ndarray]:
    for group in groups(texts):
        if sum(len(t or "") for t in group) <= 2 * GROUP_CHARS:
            for raw in bpe.encode_many([t or "" for t in group]):
                yield np.frombuffer(raw, np.int32)
        else:
            for t in group:
                yield np.concatenate(list(ids_of(bpe, t)))


def encode(df: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every row.

    A null or empty text has no ids. Rows with equal or null ids stay separate
    rows. Other columns are left out, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = loaded(spec)
        for batch in batches:
            ids = [x.tolist() for x in encoded(bpe, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(df: DataFrame, spec: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` from ids; null ids give null. Bytes that are no UTF-8 become U+FFFD. Ids outside the vocabulary are an error."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = loaded(spec)
        for batch in batches:
            texts = [None if x is None else decode(bpe, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(df: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encode and decode again in one pass, keeping no ids."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = loaded(spec)
        number, token = bpe.number.__getitem__, bpe.text.__getitem__
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for ids in encoded(bpe, batch.column(1).to_pylist()):
                flat = ids.tolist()
                back = b"".join(map(token, flat)).decode("utf-8", "replace")
                counts.append(len(flat))
                id_digests.append(hashlib.sha256(",".join(map(number, flat)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), vocabulary())


def vocabulary(path: str | None = None) -> str:
    """Text of the tokenizers file; read on the driver and sent with the job (1.5 MB)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()
