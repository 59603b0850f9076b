"""Token counts of a byte-level byte-pair vocabulary, merged in a heap over a linked list.

A text is cut at the vocabulary's special strings, which count one token each, and then into pieces by the pattern of the byte-level
pre-tokenizer. A piece starts as one symbol for each UTF-8 byte, linked to its neighbours. A heap holds every adjacent pair that has a merge; the pair
of the lowest rank, of equals the leftmost, is popped again and again, and joined if it still stands. The number of tokens
of a piece is its bytes less its merges; no list of token numbers is made. A piece of n bytes takes n log n steps, so a text without any white space is no
special case. Words and pieces counted before are remembered by each Python worker, up to ``REMEMBERED`` of each.

The vocabulary file is read by the driver and broadcast; its size (a few MB) is the bound on what is sent. Texts are not moved: counting is one scan.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrat.llm.text import append_columns, text_slices

#: Fixed value: the split of byte-level pre-tokenizers, which the files name by ``use_regex`` only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

REMEMBERED = 1 << 19
_LONGEST_REMEMBERED = 64
_BITS = 20
_SYMBOL = (1 << _BITS) - 1
_PLACE_BITS = 40
_PLACE = (1 << _PLACE_BITS) - 1


@dataclass
class Vocabulary:
    """``start`` has the symbol of each byte; ``merges`` maps a pair of symbols to its rank and the joined symbol, both packed in one number, and
    ``of_bytes`` does so for pairs of bytes."""

    start: list[int]
    merges: dict[int, int]
    special: list[str]
    digest: str = ""
    of_bytes: dict[tuple[int, int], int] = field(init=False)

    def __post_init__(self) -> None:
        pairs = {(a, b): self.merges.get(self.start[a] << _BITS | self.start[b]) for a in range(256) for b in range(256)}
        self.of_bytes = {pair: found for pair, found in pairs.items() if found is not None}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in such files: printable bytes for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> Vocabulary:
    """Read a ``tokenizers`` file of a byte-level byte-pair model; a file with any other step is refused."""
    with open(path, "rb") as file:
        data = file.read()
    content = json.loads(data)
    model, split = content["model"], content.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and not content.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    )
    added = content.get("added_tokens") or []
    if not plain or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} is not a plain byte-level byte-pair vocabulary.")
    numbers = model["vocab"]
    if len(numbers) >= 1 << _BITS:
        raise ValueError(f"{path} has more than {(1 << _BITS) - 1} entries.")
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[numbers[left] << _BITS | numbers[right]] = rank << _BITS | numbers[left + right]
    return Vocabulary([numbers[c] for c in _byte_letters()], merges, sorted((t["content"] for t in added), key=len, reverse=True), hashlib.sha256(data).hexdigest())


def count_merged(data: bytes, vocabulary: Vocabulary) -> int:
    """Number of symbols that are left of the bytes after all merges.

    The heap's numbers are (rank, joined symbol, place), packed, so that its least is the leftmost pair of the lowest rank.
    """
    n, find = len(data), vocabulary.merges.get
    heap = [f << _PLACE_BITS | k for k, f in enumerate(map(vocabulary.of_bytes.get, zip(data, data[1:]))) if f is not None]
    if not heap:
        return n
    heapify(heap)
    symbols = [vocabulary.start[b] for b in data]
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        top = heappop(heap)
        k = top & _PLACE
        mine, follower = symbols[k], after[k]
        # One of the two may have been joined to another symbol since.
        if mine < 0 or follower == n or find(mine << _BITS | symbols[follower]) != top >> _PLACE_BITS:
            continue
        joined = top >> _PLACE_BITS & _SYMBOL
        symbols[k], symbols[follower] = joined, -1
        beyond, ahead = after[follower], before[k]
        after[k] = beyond
        left -= 1
        if beyond < n:
            before[beyond] = k
            found = find(joined << _BITS | symbols[beyond])
            if found is not None:
                heappush(heap, found << _PLACE_BITS | k)
        if ahead >= 0:
            found = find(symbols[ahead] << _BITS | joined)
            if found is not None:
                heappush(heap, found << _PLACE_BITS | ahead)
    return left


class Uneven(Exception):
    """White space other than one space or one line break between two words."""


class _Remembered(dict):
    """Counts by text, worked out by ``count`` when they are first asked for."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, text: str) -> int:
        n = self.count(text)
        if len(text) <= _LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = n
        return n


class TokenCounter:
    """Counts the tokens of whole texts.

    A piece never reaches over white space but for one space before it, so a word between single spaces or line breaks counts the same wherever
    it stands, and is looked up whole. Texts with other white space are cut into pieces from end to end.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(PATTERN)
        special = "|".join(map(regex.escape, vocabulary.special))
        self.special = regex.compile(special) if special else None
        self.pieces = _Remembered(self._merge)
        self.words = _Remembered(lambda word: self._count_word(word, ""))
        self.spaced = _Remembered(lambda word: self._count_word(word, " "))

    def _merge(self, piece: str) -> int:
        return count_merged(piece.encode("utf-8", "surrogatepass"), self.vocabulary)

    def _cut(self, text: str) -> int:
        pieces = self.pieces
        return sum(pieces[m[0]] for m in self.pattern.finditer(text))

    def _count_word(self, word: str, before: str) -> int:
        if self.letters.fullmatch(word):
            return self._merge(before + word)
        if self.even.fullmatch(word):
            return self._cut(before + word)
        raise Uneven

    letters = regex.compile(r"\p{L}+")
    even = regex.compile(r"\S(?:.*\S)?", regex.DOTALL)

    def _count_part(self, text: str) -> int:
        lines = text.split("\n")
        try:
            n = (len(lines) - 1) * self.pieces["\n"]
            for line in lines:
                words = line.split(" ")
                n += self.words[words[0]]
                n += sum(map(self.spaced.__getitem__, words[1:]))
            return n
        except Uneven:
            return self._cut(text)

    def count(self, text: str) -> int:
        if not self.special:
            return self._count_part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._count_part, parts))


_counters: dict[str, TokenCounter] = {}


def _counter(digest: str, shared: Broadcast) -> TokenCounter:
    """The counter of a Python worker, which keeps what it remembers from task to task; one vocabulary at a time."""
    if digest not in _counters:
        _counters.clear()
        _counters[digest] = TokenCounter(shared.value)
    return _counters[digest]


def count_tokens(documents: DataFrame, vocabulary_path: str, text: str = "text", tokens: str = "__tokens", size: str = "__bytes") -> DataFrame:
    """``documents`` with the UTF-8 bytes and the tokens of each whole text as two more columns of long numbers.

    Special strings of the vocabulary inside texts are tokens; none is added at either end. A NULL or empty text has 0 of both. Bytes that are no
    UTF-8 count as the replacement character. Every row is counted for itself, so repeated rows, NULLs elsewhere, extra columns and an empty table change
    nothing; a ``tokens`` or ``size`` that is a column already is an error.
    """
    taken = {c.lower() for c in documents.columns}
    if {tokens.lower(), size.lower()} & taken or tokens.lower() == size.lower():
        raise ValueError(f"The columns {size!r} and {tokens!r} must be new and different.")
    vocabulary = read_vocabulary(vocabulary_path)
    digest = vocabulary.digest
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(digest, shared)
        for batch in text_slices(batches, text):
            column = batch.column(text).cast(pa.binary())
            n = [counter.count(t.decode("utf-8", "replace")) if t else 0 for t in (v.as_py() for v in column)]
            sizes = pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())
            yield append_columns(batch, **{size: sizes, tokens: pa.array(np.array(n, dtype=np.int64))})

    schema = StructType([*documents.schema.fields]).add(size, "long").add(tokens, "long")
    return documents.mapInArrow(count, schema)


def drop_over_limit(documents: DataFrame, vocabulary_path: str, limit: int, text: str = "text") -> DataFrame:
    """The documents of at most ``limit`` tokens, with their own columns only."""
    counted = count_tokens(documents, vocabulary_path, text)
    return counted.where(F.col("__tokens") <= limit).select(*documents.columns)
