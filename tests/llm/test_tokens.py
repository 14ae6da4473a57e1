"""Byte-level encoding, packed files and unigram counts against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer, models

from ringweave.llm import bpe, token_count, token_pack
from tests.llm.conftest import rows_of

PIECES = ["a", " ", "\n", "  ", " ", "'s", "1", "é", "é", "日", "\t", "aaaa", "the", " the", "<|endoftext|>", "<|", "\x1c", "́", "!", " ", "ing", "$$$", "\r\n", "🙂", "'", "İ", "ΑΣ", ",", ".́"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_file():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_file():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_speculation_equals_the_library(byte_file):
    own = bpe.loaded(bpe.vocabulary())
    texts = random_texts(20_000) + ["thththerhethe" * 9, "zqxjkvbp" * 40]
    found = [x.tolist() for x in bpe.encoded(own, texts)]
    want = [e.ids for e in byte_file.encode_batch(texts, add_special_tokens=False)]
    assert found == want
    assert [bpe.decode(own, x) for x in found] == [byte_file.decode(x, skip_special_tokens=False) for x in want]


def test_both_exact_merges_agree():
    own, r = bpe.loaded(bpe.vocabulary()), random.Random(3)
    words = ["".join(r.choices("theringstaolud", k=r.randint(1, 40))).encode() for _ in range(3000)]
    assert own.merge_short(words) == [own.merge(w) for w in words] == own.encode_pieces(words)


def test_decoding_broken_characters(byte_file):
    own = bpe.loaded(bpe.vocabulary())
    ids = next(bpe.encoded(own, ["日🙂"])).tolist()
    for cut in (ids[:-1], ids[1:]):
        assert bpe.decode(own, cut) == byte_file.decode(cut, skip_special_tokens=False)


def test_unsound_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBpe('{"model": {"type": "BPE", "vocab": {}, "merges": []}}')


def test_digests_of_odd_documents(odd_docs, no_docs, byte_file):
    found = sorted(rows_of(bpe.digests(odd_docs, bpe.vocabulary())), key=str)
    want = []
    for r in odd_docs.collect():
        ids = byte_file.encode(r.text or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), byte_file.decode(ids, skip_special_tokens=False))]
        want.append((r.doc_id, len(ids), *digest))
    assert found == sorted(want, key=str)
    assert rows_of(bpe.digests(no_docs, bpe.vocabulary())) == []


def test_encode_then_decode(odd_docs):
    ids = bpe.encode(odd_docs, bpe.vocabulary())
    back = rows_of(bpe.decoded(ids, bpe.vocabulary()))
    assert sorted(back, key=str) == sorted([(r.doc_id, r.text or "") for r in odd_docs.collect()], key=str)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 20])
def test_packing_round_trip(bits, tmp_path):
    import pyarrow.fs as pafs

    r = np.random.default_rng(bits)
    packer = token_pack.Packer(1 << bits)
    parts = [r.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 3, 9000, 1, 4096, 77)]
    for i, p in enumerate(parts):
        packer.add(None if i == 1 else i, p)
    fs = pafs.LocalFileSystem()
    with fs.open_output_stream(str(tmp_path / "x.ids")) as f:
        packer.write(f)
    with fs.open_input_file(str(tmp_path / "x.ids")) as f:
        file = token_pack.PackedFile(f)
        assert file.bits == bits and file.keys == [0, None, 2, 3, 4, 5]
        assert all((file.document(i) == p).all() for i, p in enumerate(parts))
        whole = np.concatenate(parts)
        assert (file.ids(4000, 9001) == whole[4000:9001]).all() and (file.ids(0, len(whole)) == whole).all()
    size = (tmp_path / "x.ids").stat().st_size
    assert size < len(whole) * bits / 8 + 500


def test_ids_outside_the_vocabulary_are_refused():
    with pytest.raises(ValueError, match="outside"):
        token_pack.Packer(100).add(1, np.array([100]))


@pytest.mark.parametrize(("vocab", "read"), [(70_000, 1 << 20), (70_000, 40), (300, 7)])
def test_checksums_by_stretches(tmp_path, monkeypatch, vocab, read):
    monkeypatch.setattr(token_pack, "READ_IDS", read)
    r, packer = np.random.default_rng(5), token_pack.Packer(vocab)
    parts = [r.integers(0, vocab, n).astype(np.uint32) for n in (0, 3, 100, 0, 39, 1, 41, 500, 0)]
    for i, p in enumerate(parts):
        packer.add(i, p)
    with pafs.LocalFileSystem().open_output_stream(str(tmp_path / "x.ids")) as f:
        packer.write(f)
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.ids")) as f:
        assert token_pack.checksums(token_pack.PackedFile(f)) == [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]


def test_words_are_learnt_together(word_file):
    """Words that lower case or a normal form takes apart are found out and encoded one by one."""
    own = token_pack.loaded(token_pack.vocabulary())
    words = ["İstanbul", "straße", "ǅabc", "日本語", "ﬁ", "ΟΔΟΣ", "don", "x" * 400, "क", "ªº", "Å", "𝔘𝔫", *(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(600))]
    want = [e.ids for e in word_file.encode_batch(words, add_special_tokens=False)]
    assert [x.tolist() for x in own.whole(words)] == want
    text = " ".join(words)
    assert [x.tolist() for x in own.whole([text, None, "", text * 30])] == [e.ids for e in word_file.encode_batch([text, "", "", text * 30], add_special_tokens=False)]


def test_word_encoder_equals_the_library(word_file):
    own, texts = token_pack.loaded(token_pack.vocabulary()), random_texts(20_000, 2)
    assert [own.ids(t).tolist() for t in texts] == [e.ids for e in word_file.encode_batch(texts, add_special_tokens=False)]


def test_packed_files_of_odd_documents(odd_docs, no_docs, word_file, tmp_path):
    spec = token_pack.vocabulary()
    manifest = token_pack.write_packed(odd_docs, spec, f"file://{tmp_path}/a", file_ids=50)
    files = {(r.part, r.seq): r.n_ids for r in manifest.collect()}
    assert all(n >= 50 for (part, seq), n in files.items() if (part, seq + 1) in files)  # a file ends with the document that fills it
    found = rows_of(token_pack.read_packed(manifest, f"file://{tmp_path}/a"))
    ids = {}
    for r in odd_docs.collect():
        x = np.array([*word_file.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(r.doc_id, []).append((len(x), zlib.crc32(x.tobytes())))
    assert sorted([(d, n, c) for d, _, n, c in found], key=str) == sorted([(d, *x) for d, xs in ids.items() for x in xs], key=str)
    by_start = sorted(found, key=lambda r: r[1])
    assert [r[0] for r in by_start] == sorted((r[0] for r in found), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in by_start] == [sum(r[2] for r in by_start[:i]) for i in range(len(by_start))]
    empty = token_pack.write_packed(no_docs, spec, f"file://{tmp_path}/b")
    assert rows_of(token_pack.read_packed(empty, f"file://{tmp_path}/b")) == []


def test_shared_scores_equal_a_unigram_model(docs):
    trie = token_count.loaded(token_count.vocabulary())
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *trie.pieces.items()], 0, False))
    words = sorted({w for r in docs.limit(40).collect() for w in r.text.split()}) + ["日本語", "☃☃", "x" * 100]
    for w in words:
        tokens = library.encode(token_count.MARK + w, add_special_tokens=False)
        assert trie.terminal(token_count.MARK + w) == sum(len(t.encode()) if i == 0 else 1 for t, i in zip(tokens.tokens, tokens.ids, strict=True)), w


def test_ties_take_fewest_tokens_and_a_small_trie_starts_anew():
    pieces = {"a": -1.0, "b": -1.0, "ab": -2.0, token_count.MARK: -1.0}
    assert token_count.Trie(pieces).terminal(token_count.MARK + "ab") == 2
    small = token_count.Trie(pieces, most_nodes=3)
    assert small.count_texts(["ab ba", "abab  ab", "", "é"]) == [2 + 3, 3 + 2, 0, 1 + 2]


def test_counts_of_odd_documents(odd_docs, no_docs):
    trie = token_count.loaded(token_count.vocabulary())
    found = sorted(rows_of(token_count.token_counts(odd_docs, token_count.vocabulary())), key=str)
    want = [(r.doc_id, sum(trie.terminal(token_count.MARK + w.decode()) for w in (r.text or "").encode().split())) for r in odd_docs.collect()]
    assert found == sorted(want, key=str)
    assert rows_of(token_count.token_counts(no_docs, token_count.vocabulary())) == []
