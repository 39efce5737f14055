"""Byte-pair encoding of a whole corpus with a public vocabulary.

Words are cut by the vocabulary's pattern and merged in a contiguous array: the boundaries of a word's parts and the rank of
each adjacent pair are kept side by side; the smallest rank is looked up, its inner boundary deleted, and the two
neighbouring ranks are computed anew, until no pair is in the vocabulary. That is quadratic in the length of a word, so words
of more than ``SHORT_WORD`` bytes use linked parts and a heap, with the same result. Words met before come from a bounded
cache.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts texts to words for byte_bpe_50k.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of a word up to which the array is scanned.
SHORT_WORD = 128
#: Words that the cache of a worker holds, and the bytes of the longest.
CACHE_WORDS, CACHE_BYTES = 200_000, 64
NO_RANK = 1 << 60


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """``{token: rank}`` of a file with a base64 token and its rank in each line."""
    return parse_vocabulary(Path(path).read_bytes())


def parse_vocabulary(content: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Encoder:
    """Encodes texts with a vocabulary of byte strings and ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORD_PATTERN):
        # white space as in Unicode's property: Python's \s has the separators 1C-1F besides
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ranks = ranks
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and for the empty text."""
        if not text:
            return []
        ids: list[int] = []
        cache = self.cache
        for word in self.words(text):
            known = cache.get(word)
            if known is None:
                known = self.word_ids(word.encode("utf-8", "replace"))
                if len(word) <= CACHE_BYTES:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = known
            ids.extend(known)
        return ids

    def word_ids(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self.scan_merge(word) if len(word) <= SHORT_WORD else self.heap_merge(word)

    def scan_merge(self, word: bytes) -> list[int]:
        """By a contiguous array of boundaries and adjacent ranks."""
        rank_of = self.ranks.get
        starts = list(range(len(word) + 1))
        pair_ranks = [rank_of(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
        while pair_ranks:
            lowest = min(pair_ranks)
            if lowest == NO_RANK:
                break
            at = pair_ranks.index(lowest)  # the leftmost, on a tie
            del starts[at + 1], pair_ranks[at]
            if at < len(pair_ranks):
                pair_ranks[at] = rank_of(word[starts[at] : starts[at + 2]], NO_RANK)
            if at:
                pair_ranks[at - 1] = rank_of(word[starts[at - 1] : starts[at + 1]], NO_RANK)
        return [self.ranks[word[a:b]] for a, b in zip(starts, starts[1:])]

    def heap_merge(self, word: bytes) -> list[int]:
        """By linked parts and a heap of pairs, for words of any length."""
        rank_of, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, left, end = heapq.heappop(queue)
            right = after[left] if alive[left] else n
            if right >= n or after[right] != end:
                continue  # one of the parts has changed since
            alive[right] = False
            after[left] = end
            if end < n:
                before[end] = left
                if (r := rank_of(word[left : after[end]])) is not None:
                    heapq.heappush(queue, (r, left, after[end]))
            if before[left] >= 0 and (r := rank_of(word[before[left] : end])) is not None:
                heapq.heappush(queue, (r, before[left], end))
        return [self.ranks[word[i : after[i]]] for i in range(n) if alive[i]]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(parse_vocabulary(content))
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, ids)``: the token ids of each text, a list that is empty for null and empty texts.

    One pass without a shuffle, in Arrow batches; whole texts of any length, ids null or given twice kept row by row, other
    columns not read. The vocabulary (under a megabyte, whatever the data) is read once by the driver and travels in a
    broadcast variable, so executors need no file. An empty table gives an empty one.
    """
    spread = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(spread.value).encode
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # small pieces: texts may be long
                piece = batch.slice(start, 512)
                offsets, ids = [0], []
                for value in piece.column(1):
                    ids.extend(encode(value.as_py()))
                    offsets.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=[id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, tokens)``: how many ids :func:`encode_texts` gives, without moving them out of the workers."""
    spread = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(spread.value).encode
        for batch in batches:
            counts = [len(encode(value.as_py())) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[id_col, "tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, tokens bigint")
