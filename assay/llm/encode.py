"""Encoding a corpus with a byte-level BPE by a trie of words.

BPE has this property: the encoding of a text's prefix ends in exactly one token
t such that t and the last token before it stand together (BPE of their joined
bytes gives just these two). So the distinct words of a batch go into one trie;
depth first, each node gets its last token, found among the tokens that end its
path, and a link to the node before that token. A shared prefix is worked out
once, and a word's ids are read off by following the links.

No shuffle: every task keeps its trie and its table of words between batches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Where the public byte-level BPE splits a text into words before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A trie or table larger than this many nodes or words is dropped and begun anew; results don't depend on it.
MOST_NODES = 1_000_000


def vocabulary_bytes(path: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The vocabulary file, by default of the installed public tokenizers: under 1 MB, so it can be broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as file:
        return file.read()


class TrieEncoder:
    """ids of texts by a byte-level BPE given as lines of base64 token and rank."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest: dict[bytes, int] = {}  # of the tokens that end in two given bytes the length of the longest
        for token in self.ranks:
            self.longest[token[-2:]] = max(self.longest.get(token[-2:], 0), len(token))
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]
        self.before: list[int] = [-1]

    def merged(self, text: bytes) -> list[int]:
        """Plain BPE, for texts of one or two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stand(self, left: int, right: int) -> bool:
        """Whether right may follow left; left -1 is a word's start."""
        if right not in self.whole:
            self.whole[right] = self.merged(self.tokens[right]) == [right]
        if left < 0 or not self.whole[right]:
            return self.whole[right]
        if (left, right) not in self.pairs:
            self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return self.pairs[left, right]

    def learn(self, words: list[str]) -> None:
        """Inserts words into the trie in order, so depth first; a new node gets its last token from the states on its path, a known one keeps its
        own. The words' ids are kept."""
        steps, last, before, ranks, longest = self.steps, self.last, self.before, self.ranks, self.longest
        for word in sorted(words):
            text = word.encode("utf-8", "surrogatepass")
            nodes, node = [0], 0
            for depth, byte in enumerate(text):
                child = steps[node].get(byte)
                if child is None:
                    child = steps[node][byte] = len(steps)
                    steps.append({})
                    end = depth + 1
                    for n in range(min(end, longest.get(text[depth - 1 : end], 1) if depth else 1), 0, -1):
                        token = ranks.get(text[end - n : end])
                        if token is not None and self.stand(last[nodes[end - n]], token):
                            last.append(token)
                            before.append(nodes[end - n])
                            break
                node = child
                nodes.append(node)
            ids = []
            while node:
                ids.append(last[node])
                node = before[node]
            self.words[word] = tuple(reversed(ids))

    def _split(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them in the table."""
        if len(self.steps) > MOST_NODES or len(self.words) > MOST_NODES:
            self.reset()
        split = [self.split(t) if t else [] for t in texts]
        known = self.words
        if new := {w for words in split for w in words if w not in known}:
            self.learn(list(new))
        return split

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null and empty texts have no ids."""
        split, get = self._split(texts), self.words.__getitem__
        parts = [list(chain.from_iterable(map(get, words))) for words in split]
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return offsets, np.fromiter(chain.from_iterable(parts), np.int32, int(offsets[-1]))

    def count(self, texts: list[str | None]) -> list[int]:
        """How many ids encode() gives for each text."""
        split, get = self._split(texts), self.words.__getitem__
        return [sum(map(len, map(get, words))) for words in split]


def _encoder(vocabulary):
    encoder = None

    def get() -> TrieEncoder:
        nonlocal encoder
        if encoder is None:
            encoder = TrieEncoder(vocabulary.value)
        return encoder

    return get


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def encoded(df: DataFrame, key: str, text: str, vocabulary_path: str | None = None) -> DataFrame:
    """(key, ids array<int>): every row's text by the byte-level BPE, without special tokens.

    Null and empty texts give an empty list, blank ones the ids of their blanks; strings that look like special
    tokens are ordinary text. Rows with a null key keep it. Long texts are encoded whole. Order isn't kept.
    """
    ship(df.sparkSession)
    vocabulary = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary_path))
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)()
        for batch in _pieces(batches, 1000):
            offsets, ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], schema=schema)

    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "key long, ids array<int>").select(F.col("key").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str, carry: list[str], vocabulary_path: str | None = None) -> DataFrame:
    """(key, n_tokens, *carry): the number of ids that encoded() gives, with string columns carried along."""
    ship(df.sparkSession)
    vocabulary = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary_path))
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.string()) for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)()
        for batch in _pieces(batches, 1000):
            sizes = encoder.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *batch.columns[2:]], schema=schema)

    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in carry])
    return source.mapInArrow(run, "key long, n_tokens long" + "".join(f", `{c}` string" for c in carry)).withColumnRenamed("key", key)
