"""Encoding of texts with the rank file of a public byte-level BPE tokenizer.

Method: prefix-sharing trie traversal. The distinct words of a batch of texts are sorted, which is the
depth-first order of their trie. The state of a trie node is the last token of the encoding of its
prefix; a stack holds the states on the way from the root, so a prefix shared by many words is encoded
once. The encoding of a word is read off the stack backwards.

The last token of a prefix is found without the encodings of its parts: of the tokens that end the
prefix, it is the one that may follow the last token of what is before it. Two tokens may follow each
other if no merge across their border would have come before the merges within them.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how texts are split before merging, as the tokenizer defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for text of ASCII only, where the standard library's faster engine will do.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: Words whose encodings a worker keeps, and bytes of such words. Beyond either it starts afresh.
KEPT_WORDS, KEPT_BYTES = 400_000, 24_000_000
#: Bytes of the largest vocabulary file that is sent to executors.
LARGEST_FILE = 64_000_000


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary files are installed; pass another path to use another place."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


class Vocabulary:
    """Tokens and their ids, which are the order of merges, of a rank file, given by its path or contents."""

    def __init__(self, source: str | bytes):
        if isinstance(source, str):
            with open(source, "rb") as file:
                source = file.read()
        self.ids = {base64.b64decode(token): int(rank) for token, rank in (
            line.split() for line in source.splitlines() if line.strip()
        )}
        ids = self.ids
        # Each token's two halves: what its last merge joined. A single byte is its own halves.
        self.left, self.right = [0] * len(ids), [0] * len(ids)
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ids.items():
            a, b = self._halves(token, rank) if len(token) > 1 else (rank, rank)
            self.left[rank], self.right[rank] = a, b
            if len(token) > 1:
                self.pairs[a, b] = rank
        # Tokens by their bytes from the end, to find all tokens that end a text.
        self.endings: dict = {}
        for token, rank in ids.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.length = [0] * len(ids)
        for token, rank in ids.items():
            self.length[rank] = len(token)
        self.follows: dict[tuple[int, int], bool] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.ids.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b directly after token a is what merging their joined bytes gives.

        The halves on both sides of the border are taken apart in the reverse order of their merges;
        a merge across the border that is earlier than the piece last taken apart would have come first.
        """
        known = self.follows.get((a, b))
        if known is not None:
            return known
        key, before, good = (a, b), len(self.length), True
        pairs, left, right = self.pairs, self.left, self.right
        while True:
            merged = pairs.get((a, b))
            if merged is not None and merged < before:
                good = False
                break
            # Undo the later of the two pieces; at equal rank the right one was merged later.
            if a > b:
                if right[a] == a and left[b] == b:
                    break
                if right[a] == a:
                    before, b = b + 1, left[b]
                else:
                    before, a = a, right[a]
            else:
                if right[a] == a and left[b] == b:
                    break
                if left[b] == b:
                    before, a = a, right[a]
                else:
                    before, b = b + 1, left[b]
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        self.follows[key] = good
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words in sorted order: a depth-first walk through their trie."""
        endings, length, may_follow, follows = self.endings, self.length, self.may_follow, self.follows
        last: list[int] = []  # of each prefix of the word at hand, the last token
        out, previous = [], b""
        for word in words:
            shared = 0
            for x, y in zip(word, previous):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared, len(word)):
                node, at, chosen = endings, end, -1
                while True:
                    node = node.get(word[at])
                    if node is None:
                        break
                    token = node.get(-1)
                    if token is not None:
                        if at == 0:
                            chosen = token
                            break
                        key = (last[at - 1], token)
                        if follows[key] if key in follows else may_follow(*key):
                            chosen = token
                            break
                    if at == 0:
                        break
                    at -= 1
                last.append(chosen)
            ids, k = [], len(word)
            while k:
                token = last[k - 1]
                ids.append(token)
                k -= length[token]
            ids.reverse()
            out.append(ids)
            previous = word
        return out


def _ends(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive pieces begins, and the end of the last."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


class Encoder:
    """Encodes texts; keeps the encodings of words, within bounds, from batch to batch."""

    def __init__(self, source: str | bytes):
        self.vocabulary = Vocabulary(source)
        self.split, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self._afresh()

    def _afresh(self) -> None:
        self.number: dict[str, int] = _Numbers()
        self.ids, self.starts, self.bytes = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _learn(self) -> None:
        """Encode the words that were numbered since the last time."""
        known = len(self.starts) - 1
        new = list(self.number)[known:] if known < len(self.number) else []
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        encoded: list = [None] * len(raw)
        for i, ids in zip(order, self.vocabulary.encode_words([raw[i] for i in order])):
            encoded[i] = ids
        self.bytes += sum(map(len, raw))
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((t for ids in encoded for t in ids), np.int32, int(lengths.sum()))
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, one after the other, and where each text's begin."""
        if len(self.number) > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self._afresh()
        number, numbers, counts = self.number.__getitem__, [], []
        for text in texts:
            if text:
                words = (self.split_ascii if text.isascii() else self.split)(text)
                numbers.append(np.fromiter(map(number, words), np.int64, len(words)))
                counts.append(len(words))
            else:
                counts.append(0)
        self._learn()
        return np.concatenate(numbers) if numbers else np.zeros(0, np.int64), _ends(np.array(counts, np.int64))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin."""
        words, begins = self.words(texts)
        first = self.starts[words]
        sizes = self.starts[words + 1] - first
        ends = _ends(sizes)
        at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)
        return self.ids[at], ends[begins]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Numbers of ids of the texts."""
        words, begins = self.words(texts)
        ends = _ends(self.starts[words + 1] - self.starts[words])
        return np.diff(ends[begins])


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_ENCODERS: dict[int, Encoder] = {}


def encoder(contents: bytes) -> Encoder:
    """The encoder of this worker process; workers are reused from task to task."""
    key = zlib.crc32(contents) << 32 | len(contents)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(contents)
    return _ENCODERS[key]


def vocabulary_everywhere(spark: SparkSession, path: str | None) -> Broadcast:
    """The contents of a vocabulary file, read where the query is made and sent to the executors, which
    need not have it. The file of a public tokenizer has a few megabytes; a larger one is refused."""
    with open(path or default_vocabulary(), "rb") as file:
        contents = file.read(LARGEST_FILE + 1)
    if len(contents) > LARGEST_FILE:
        raise ValueError(f"a vocabulary of more than {LARGEST_FILE} bytes")
    return spark.sparkContext.broadcast(contents)


#: Characters encoded at once, so that a batch of long texts needs little memory.
AT_ONCE = 4_000_000


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_column(df: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the whole text of every row as token ids, without special tokens.

    Strings that look like special tokens are ordinary text. A NULL or empty text gives an empty
    list. Every row comes out once, also repeated rows and rows with a NULL id; further columns are
    ignored. Texts do not leave their partition: there is no shuffle.
    """
    shared = vocabulary_everywhere(df.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _portions(texts):
                ids, begins = own.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "ids"])

    source = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def count_column(df: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, tokens): the number of ids that ``encode_column`` gives; 0 for NULL and empty texts."""
    shared = vocabulary_everywhere(df.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _portions(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(own.count(texts[a:b]))],
                    names=["id", "tokens"],
                )

    source = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, tokens long").withColumnRenamed("id", id_column)
