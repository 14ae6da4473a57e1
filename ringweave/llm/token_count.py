"""Token counts of a unigram model, with forward scores shared in a trie.

A text is cut at ASCII white space; each word, with the word mark in front, is a
pre-token. Its segmentation has the highest sum of piece scores, and of equal
sums the fewest tokens. The best score and count of a prefix depend on the
prefix alone, so they sit in its trie node and are computed once for all
pre-tokens that share it; the node where a pre-token ends stores its count. A
character without a piece costs UNKNOWN below the lowest score and counts as its
UTF-8 bytes.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ringweave.llm.bpe import groups
from ringweave.llm.common import Recent, documents, segments

MARK = "▁"
UNKNOWN = 10.0
MOST_NODES = 700_000  # of one task's trie; then it starts anew
MEMO = 300_000
LAST_CODE = 0x110000


class Trie:
    """Prefixes as nodes: 0 is the empty prefix."""

    def __init__(self, pieces: dict[str, float], most_nodes: int = MOST_NODES) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.most_nodes = most_nodes
        self.memo = Recent(MEMO)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def terminal(self, word: str) -> int:
        """Tokens of one pre-token; only the nodes that no earlier one has made are computed."""
        child, score, count, pieces, longest = self.child, self.score, self.count, self.pieces, self.longest
        node, path = 0, [0]
        for depth, char in enumerate(word, 1):
            key = node * LAST_CODE + ord(char)
            node = child.get(key, -1)
            if node < 0:
                above = path[-1]
                best, tokens = score[above] + self.unknown, count[above] + len(char.encode())
                for start in range(max(0, depth - longest), depth):
                    gain = pieces.get(word[start:depth])
                    if gain is not None:
                        at = path[start]
                        total, n = score[at] + gain, count[at] + 1
                        if total > best or total == best and n < tokens:
                            best, tokens = total, n
                child[key] = node = len(score)
                score.append(best)
                count.append(tokens)
            path.append(node)
        return count[node]

    def count_texts(self, texts: list[str]) -> list[int]:
        words = [t.encode().split() for t in texts]
        wanted = set().union(*words)
        self.memo.room(len(wanted))
        for word in sorted(self.memo.missing(wanted)):
            if len(self.score) > self.most_nodes:
                self.clear()
            self.memo.young[word] = self.terminal(MARK + word.decode())
        known = self.memo.young.__getitem__
        return [sum(map(known, w)) for w in words]


_LOADED: dict[str, Trie] = {}


def loaded(model: str) -> Trie:
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _LOADED:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_proto=base64.b64decode(model))
        ids = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        _LOADED.clear()
        _LOADED[key] = Trie({m.id_to_piece(i): m.get_score(i) for i in ids})
    return _LOADED[key]


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens)`` of every row; a null or blank text has 0. Equal or null ids stay rows of their own; other columns are left out."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        trie = loaded(model)
        for batch in batches:
            counts: list[int] = []
            for some in groups(batch.column(1).to_pylist()):
                if sum(len(t or "") for t in some) <= 1 << 21:
                    counts += trie.count_texts([t or "" for t in some])
                else:
                    counts += [sum(trie.count_texts([s])[0] for s in segments(t or "")) for t in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def vocabulary(path: str | None = None) -> str:
    """The piece file (0.5 MB) in base 64, read on the driver and sent with the job."""
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return base64.b64encode(f.read()).decode()


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary())
