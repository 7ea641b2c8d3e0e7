"""Byte-level BPE by longest matches and backtracking (operator 12).

Text is cut by the vocabulary's pattern and each piece is encoded by itself. The bytes of
a piece, read as Latin-1 characters, run once through an Aho-Corasick automaton of all
tokens, which gives the longest token at every byte. Encoding takes the longest token
that may follow the one before, else the next shorter one, else it steps back and marks
the place as a dead end. Two tokens may follow each other if merging would leave them
side by side; that is found by undoing their merges, newest first, and remembered. Each
place is left at most once, so the work is linear and the ids are those of the merges.
Ranks must be a list of merges, each of two older tokens, as every trained vocabulary is.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
BATCH_BYTES = 8 << 20  # text and ids that a task hands on at once
MEMO = 1 << 20  # pairs of tokens whose compatibility a worker remembers
PIECES, PIECE = 400_000, 64  # pieces whose ids a worker remembers, and their longest length
_NEVER = 1 << 62

_codecs: dict[tuple[str, str], "Codec"] = {}


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """What the ranks say about tokens: their two parts, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.age = [-1] * size  # the rank of a token's last merge; -1 for a single byte
        self.left, self.right = [-1] * size, [-1] * size
        self.made: dict[tuple[int, int], int] = {}  # the token that two parts merge into
        self.known: dict[tuple[int, int], bool] = {}
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.rank: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1 and not self._split(token, rank):
                raise ValueError(f"merging older tokens does not make {token!r}, so these ranks are no list of merges")
            self.rank[token] = rank
        for token, rank in self.rank.items():
            cuts = (self.rank.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((prefix for prefix in cuts if prefix >= 0), -1)

    def _split(self, token: bytes, rank: int) -> bool:
        """Find the two older tokens that merging the bytes leaves before this token is made."""
        for n in range(len(token) - 1, 0, -1):
            a, b = self.rank.get(token[:n], -1), self.rank.get(token[n:], -1)
            if a >= 0 and b >= 0 and self._apart(a, b):
                self.left[rank], self.right[rank], self.age[rank] = a, b, rank
                self.made[a, b] = rank
                return True
        return False

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the joint bytes of two tokens ends with just these two.

        Undoes the newest merge of either side, the right one first among equals, as equal
        pairs merge from the left. If the neighbours across the border could have merged
        before that, they would have.
        """
        until = _NEVER
        while True:
            if self.made.get((a, b), _NEVER) < until:
                return False
            x, y = self.age[a], self.age[b]
            if x > y:
                a, until = self.right[a], x
            elif y >= 0:
                b, until = self.left[b], y + 1
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        pair = (a, b)
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            found = self.known[pair] = self._apart(a, b)
        return found


class Codec(dict):
    """Pieces and their packed ids; a missing piece is encoded and kept. A full memory is begun anew."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import ahocorasick
        import regex

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        self.ranks = ranks
        self.merges = Merges(ranks)
        self.token = {rank: token for token, rank in ranks.items()}
        self.length = [len(self.token.get(rank, b"")) for rank in range(max(ranks.values()) + 1)]
        self.pieces = regex.compile(exact_spaces(pattern)).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        ids = array("I", [whole] if whole is not None else self.ids(data)).tobytes()
        if len(piece) <= PIECE:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        length, shorter, follows = self.length, self.merges.shorter, self.merges.follows
        n = len(data)
        longest = array("i", bytes(4 * n))
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # matches come by their ends, so the last one of a start is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and (dead[at + length[token]] or (out and not follows(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:  # no token fits here: the one before must end elsewhere
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


def exact_spaces(pattern: str) -> str:
    """The pattern with white space as the property of that name, whatever ``\\s`` stands for in a version of the library."""
    inside = pattern.replace(r"[^\s", r"[^\p{White_Space}")
    return inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def codec(vocabulary: str, pattern: str) -> Codec:
    """One codec per worker."""
    if (vocabulary, pattern) not in _codecs:
        _codecs[vocabulary, pattern] = Codec(read_ranks(vocabulary), pattern)
    return _codecs[vocabulary, pattern]


def _sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``BATCH_BYTES`` in a column."""
    size, lo = 0, 0
    for k, value in enumerate(batch.column(column)):
        size += value.as_buffer().size if value.is_valid else 0
        if size >= BATCH_BYTES:
            yield batch.slice(lo, k + 1 - lo)
            size, lo = 0, k + 1
    if lo < batch.num_rows:
        yield batch.slice(lo)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; ``ids`` are packed little-endian 32-bit numbers.

    Whole texts of any length; a null or empty text has no tokens. Bytes that are no UTF-8
    count as replacement characters. Every row is encoded, repeated and null ids included;
    other columns are ignored. Special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            for part in _sliced(batch, 1):
                found = [bpe.encode(str(x.as_buffer(), "utf-8", "replace")) if x.is_valid else b"" for x in part.column(1)]
                sizes = pa.array([len(x) // 4 for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(found, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(rows: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of the result of :func:`encode`: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            for part in _sliced(batch, 2):
                text = pa.array([bpe.decode(x.as_buffer()) for x in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=["doc_id", "n_tokens", "ids", "decoded"])

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
