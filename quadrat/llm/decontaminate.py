"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task cuts its documents into shards of bounded size and sorts the shard's word suffixes. Every
suffix of every benchmark item is then looked up by binary search, for all suffixes at once; the range
found holds all places where the suffix's first words occur. Overlapping finds on one diagonal are
merged into the longest verbatim matches with their positions. No document is shuffled.

Shard words are numbered by the benchmark's own vocabulary; any other word is 0 and ends a suffix, since
no match can run over it. Suffixes too short to hold a window are left out of the array for the same
reason. Suffixes are sorted as deep as the longest window.

The benchmark passes through the driver in blocks of at most ``block_bytes``, each broadcast for one
pass over the documents; with more than one block, the passes are joined by written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.text import WORD_TABLE, append_columns, blobs, text_slices
from quadrat.operators.staging import stage

WINDOW = 10
BLOCK_BYTES = 8 << 20

MATCH = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("item_word", T.LongType()),
        T.StructField("doc_word", T.LongType()),
        T.StructField("words", T.LongType()),
    ]
)
_ARROW_MATCH = pa.list_(
    pa.struct(
        [("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())]
    )
)


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and characters outside ASCII."""
    return text.translate(WORD_TABLE).split()


class TestSuffixes:
    """The windows that start the suffixes of a block of benchmark items, as arrays of word numbers."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], int] = {}
        self.items = [name for name, _ in items]
        self.owners: list[list[tuple[int, int]]] = []  # of each window: (item, its word position there)
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text)]
            if not ids:
                continue
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1):
                number = windows.setdefault(tuple(ids[at : at + size]), len(windows))
                if number == len(self.owners):
                    self.owners.append([])
                self.owners[number].append((k, at))
        self.sizes = np.array([len(w) for w in windows], dtype=np.int64)
        self.depth = int(self.sizes.max(initial=0))
        self.least = int(self.sizes.min(initial=0))
        self.words = np.zeros((len(windows), self.depth), dtype=np.int64)
        for row, w in zip(self.words, windows):
            row[: len(w)] = w


def suffix_array(ids: np.ndarray, run: np.ndarray, least: int, depth: int, top: int) -> np.ndarray:
    """Start positions of the suffixes with at least ``least`` known words, sorted by their first ``depth`` words.

    ``run`` is the number of known words from each position on.
    """
    starts = np.flatnonzero(run >= least)
    if not len(starts):
        return starts
    bits = max(1, int(top).bit_length())
    per_key = max(1, 63 // bits)
    room = run[starts]
    keys = []
    for first in range(0, depth, per_key):
        key = np.zeros(len(starts), dtype=np.int64)
        for d in range(first, min(first + per_key, depth)):
            key = (key << bits) | np.where(room > d, ids[np.minimum(starts + d, len(ids) - 1)], 0)
        keys.append(key)
    return starts[np.lexsort(keys[::-1])]


def search(ids: np.ndarray, suffixes: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of the suffix array whose entries begin with its window."""
    n, count = len(suffixes), len(tests.sizes)

    def bound(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(count, dtype=np.int64), np.full(count, n, dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            order = np.zeros(len(open_), dtype=np.int64)  # of the entry against the test suffix
            for d in range(tests.depth):
                live = (order == 0) & (tests.sizes[open_] > d)
                if not live.any():
                    break
                at = np.minimum(suffixes[mid[live]] + d, len(ids) - 1)
                order[live] = np.sign(ids[at] - tests.words[open_[live], d])
            right = (order < 0) | ((order == 0) & after_equal)
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]

    return bound(False), bound(True)


def match_shard(words: list[list[bytes]], tests: TestSuffixes) -> list[list[tuple[int, int, int, int]]]:
    """Longest verbatim matches of each document of a shard: (item, item word, document word, words)."""
    if not len(tests.sizes):
        return [[] for _ in words]
    found: list[dict[tuple[int, int], list[tuple[int, int]]]] = [{} for _ in words]
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    number = tests.vocabulary.get
    ids = np.zeros(int(offsets[-1]), dtype=np.int64)
    for k, w in enumerate(words):
        ids[offsets[k] : offsets[k] + len(w)] = np.fromiter((number(x, 0) for x in w), np.int64, len(w))
    place = np.arange(len(ids))
    stop = np.minimum.accumulate(np.where(ids == 0, place, len(ids))[::-1])[::-1]
    suffixes = suffix_array(ids, stop - place, tests.least, tests.depth, len(tests.vocabulary))
    if not len(suffixes):
        return [[] for _ in words]
    low, high = search(ids, suffixes, tests)
    for row in np.flatnonzero(high > low):
        at = suffixes[low[row] : high[row]]
        documents = np.searchsorted(offsets, at, side="right") - 1
        size = int(tests.sizes[row])
        for doc, word in zip(documents.tolist(), (at - offsets[documents]).tolist()):
            for item, item_word in tests.owners[row]:
                found[doc].setdefault((item, word - item_word), []).append((word, size))
    out = []
    for diagonals in found:
        matches = []
        for (item, shift), places in diagonals.items():
            begin = end = None
            for word, size in sorted(places):
                if end is not None and word <= end - size + 1:
                    end = word + size
                    continue
                if end is not None:
                    matches.append((item, begin - shift, begin, end - begin))
                begin, end = word, word + size
            matches.append((item, begin - shift, begin, end - begin))
        out.append(sorted(matches))
    return out


def _pass(tests, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = tests.value
        for batch in text_slices(batches, text):
            words = [split_words(t) for t in blobs(batch, text)]
            matches = [
                [
                    {"item": suffixes.items[i], "item_word": at, "doc_word": word, "words": n}
                    for i, at, word, n in row
                ]
                for row in match_shard(words, suffixes)
            ]
            if "__matches" in batch.schema.names:
                earlier = batch.column("__matches").to_pylist()
                matches = [a + b for a, b in zip(earlier, matches)]
                batch = batch.drop_columns(["__words", "__hit", "__matches"])
            yield append_columns(
                batch,
                __words=pa.array([len(w) for w in words], pa.int64()),
                __hit=pa.array([_covered(m) for m in matches], pa.int64()),
                __matches=pa.array(matches, _ARROW_MATCH),
            )

    return run


def _covered(matches: list[dict]) -> int:
    """Words inside any match; overlapping matches count once."""
    total = end = 0
    for begin, stop in sorted((m["doc_word"], m["doc_word"] + m["words"]) for m in matches):
        total += max(0, stop - max(begin, end))
        end = max(end, stop)
    return total


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of at most ``limit`` text bytes (or one item), read one partition at a time."""
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        blob = (row[1] or "").encode()
        if block and size + len(blob) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], blob))
        size += len(blob)
    yield block


def match_benchmark(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents with ``__words`` (number of words), ``__hit`` (words inside a match) and ``__matches``.

    Words are runs of digits, letters and characters outside ASCII, with A-Z lower-cased. A match is the
    longest run of words that a document and a benchmark item share, of at least ``window`` words, or a
    whole item that has fewer. NULL and empty texts have no words and no matches, on either side; repeated
    rows are matched each for itself; an empty benchmark matches nothing, and an empty table gives an empty
    one. Other columns stay as they are. Items with the same name count as one, NULL is a name.
    """
    schema = T.StructType(
        [
            *documents.schema.fields,
            T.StructField("__words", T.LongType()),
            T.StructField("__hit", T.LongType()),
            T.StructField("__matches", T.ArrayType(MATCH)),
        ]
    )
    out = documents
    for k, block in enumerate(blocks(benchmark, item, item_text, block_bytes)):
        if k:
            out = stage(out, "decontaminate")
        tests = documents.sparkSession.sparkContext.broadcast(TestSuffixes(block, window))
        out = out.mapInArrow(_pass(tests, text), schema)
    return out


def contamination(matched: DataFrame) -> DataFrame:
    """Digest of ``match_benchmark``: words, hit words, number of items and the SHA-256 of their sorted names."""
    items = F.array_sort(F.array_distinct(F.transform("__matches", lambda m: F.coalesce(m["item"], F.lit("")))))
    return matched.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("__hit") > 0).alias("contaminated"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    matched = match_benchmark(documents, benchmark, **options)
    return matched.where(F.col("__hit") == 0).select(*[matched[c] for c in documents.columns])
