"""Language model scoring by logistic context mixing.

A text is its lower-cased words and one end, each spelled as bytes with a space behind. Every bit of every byte is predicted in six
hashed contexts (bytes before it in the word, the word so far, and both with a class of the text). A context's slot holds how often 0 and
1 followed. The six predictions are mixed in the logistic domain by a set of weights, which a gate picks by how much the two contexts of the whole
word have seen; the mix is then refined by an adaptive table over (bits so far, mixed prediction). This is the probability of a word's spelling.

Over it lie the exact counts of words in four contexts, each mixed in before the next: none, the class of the text, the word before, and the two
words before. Each is mixed with a weight that a gate picks by how often the context has been seen; a block of texts learns these weights from
its own training words, each with its own occurrence taken out of the counts. The text's score is the sum over its words, and the cost of naming
its class, which is a hash of its most frequent word.

Learning from the training documents takes three steps over all of them:

1. Documents are dealt into blocks of about ``BLOCK_BYTES`` by a hash of the id. A block's distinct words and its counts of (word, class)
   are packed by bucket of the word's hash, and each bucket adds up the counts of all blocks. This gives exact word counts, which go back
   to the blocks that hold the words, and the counts of all distinct pairs. Grams (a word with its class, the word before, or the two words
   before) go the same way as ``GRAM_BITS`` bits of their hash within a bucket; there is a bucket for every ``BLOCKS_PER_BUCKET`` blocks, so this table grows
   with the texts.
2. Contexts are counted bit by bit over the distinct pairs; tables of trainers are added up in pieces.
3. Each trainer goes through its pairs in small batches and moves the weights online after each one, always predicting with the pair's own last
   occurrence taken out of the slots; weights are averaged over the trainers and refinement tables added up.

The tables of bits have fixed sizes (about 22 MB in all), which is the bound on what is broadcast. Scoring reads a block's texts with the counts
of its words and grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.text import blobs, mixed, prefix_hashes
from quadrat.operators.staging import stage

BLOCK_BYTES = 4 << 20
#: Blocks for each bucket of words and grams; a bucket's grams are added up range by range of their keys.
BLOCKS_PER_BUCKET = 4
_RANGES = 16
CLASSES = 32
#: Slots of each context, as powers of two; the last two contexts are the word so far, without and with the class.
TABLE_BITS = (16, 18, 20, 20, 22, 22)
TRAINER_PAIRS = 1_500_000
GRAM_BITS = 36
_GRAM_MASK = np.uint64((1 << GRAM_BITS) - 1)
_GATES = 48
_ROUNDS = 6
_BATCH = 2048
_BYTES = 8192
_SPREAD = np.uint64(0x9FB21C651E98DF25)
#: Pairs of word and class whose scores a Python worker keeps from block to block, 16 bytes each.
REMEMBERED = 1 << 20
_PIECE = 1 << 16
_STEPS = 24
_SPLIT = 12.0
_CODES = np.expm1(np.arange(256) / _SPLIT * np.log(2.0))
_LOG = np.log(_CODES + 0.4).astype(np.float32)
_LOG_BUT_ONE = np.log(np.maximum(_CODES - 1.0, 0.0) + 0.4).astype(np.float32)
#: By the 16-bit number of a slot: its prediction in the logistic domain, the same with a 0 or a 1 taken out, and how much the slot has seen.
_ZEROS, _ONES = np.divmod(np.arange(1 << 16), 256)
_STRETCH = _LOG[_ONES] - _LOG[_ZEROS]
_STRETCH_BUT_ONE = np.stack([_LOG[_ONES] - _LOG_BUT_ONE[_ZEROS], _LOG_BUT_ONE[_ONES] - _LOG[_ZEROS]])
_SEEN = np.minimum(np.maximum(_ZEROS, _ONES) // 12, 7).astype(np.uint8)
_SETS = 64


@dataclass
class Numbered:
    """The words of some texts: the distinct ones with two hashes, and each occurrence as (word number, class of its text, text)."""

    tokens: list[bytes]
    sums: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    classes: np.ndarray
    owners: np.ndarray


def number_tokens(texts: list[bytes]) -> Numbered:
    """A text is its lower-cased words between ASCII white space, and the end as an empty word.

    Its class is a hash of its most frequent word (of equals, that with the least checksum), 0 without words.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    words = split.flatten()
    owners = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        words, owners = words.filter(pa.array(full)), owners[full]
    numbered = words.view(pa.large_binary()).dictionary_encode()
    tokens = [b"", *numbered.dictionary.to_numpy(zero_copy_only=False).tolist()]  # the empty word has number 0
    ends = np.cumsum(np.bincount(owners, minlength=len(texts)))
    flat = np.insert(numbered.indices.to_numpy().astype(np.int64) + 1, ends, 0)
    owners = np.insert(owners, ends, np.arange(len(texts)))
    sums = np.array([zlib.crc32(t) for t in tokens], dtype=np.int64)
    pair, often = np.unique(owners * len(tokens) + flat, return_counts=True)
    owner, word = pair // len(tokens), pair % len(tokens)
    rank = np.where(word == 0, -1, often << 32 | 0xFFFFFFFF - sums[word])
    first = np.maximum.reduceat(rank, np.searchsorted(owner, np.arange(len(texts)))) if len(texts) else rank
    kind = np.where(first < 0, 0, 1 + (0xFFFFFFFF - (first & 0xFFFFFFFF)) % (CLASSES - 1))
    return Numbered(tokens, sums, hash_tokens(tokens), flat, kind[owners], owners)


def distinct_below(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of integers below ``most`` in order, and the place of each value among them; small ranges need no sort."""
    if most > 16 * len(values):
        return np.unique(values, return_inverse=True)
    met = np.zeros(most, dtype=bool)
    met[values] = True
    return np.flatnonzero(met), (np.cumsum(met, dtype=np.int32) - 1)[values]


def sort_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order of keys below 2^``bits``; their high bits are sorted together with the places, which takes a fraction of the time of an argsort."""
    low = max(1, (len(keys) - 1).bit_length())
    drop = max(0, bits + low - 64)
    packed = np.sort((keys >> np.uint64(drop)) << np.uint64(low) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    if drop:
        ordered = keys[order]
        if (ordered[1:] < ordered[:-1]).any():  # keys that differ in the dropped bits only
            return np.argsort(keys)
    return order


def number_keys(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the last of each distinct key, in the order of the keys, and the number of each key among the distinct ones."""
    order = sort_order(keys, bits)
    ordered = keys[order]
    last = np.append(ordered[1:] != ordered[:-1], True) if len(keys) else np.zeros(0, dtype=bool)
    number = np.empty(len(keys), dtype=np.int32)
    number[order] = np.cumsum(last) - last
    return order[last], number


# --- counts of words --------------------------------------------------------------------------------


def _pack(tokens: list[bytes]) -> bytes | None:
    return zlib.compress(b" ".join(tokens), 1) if tokens else None


def _unpack(data: bytes | None) -> list[bytes]:
    return [] if data is None else zlib.decompress(data).split(b" ")


class _Ints:
    """Numbers from 0 on, packed piece by piece: a byte each, behind them those from 255 on in eight bytes, and how many these are."""

    def __init__(self) -> None:
        self.small, self.packed, self.large = zlib.compressobj(1), [], []

    def add(self, values: np.ndarray) -> None:
        self.packed.append(self.small.compress(np.minimum(values, 255).astype(np.uint8).tobytes()))
        self.large.append(values[values >= 255].astype("<i8").tobytes())

    def done(self) -> bytes:
        rest = b"".join(self.large)
        return b"".join([*self.packed, self.small.compress(rest + (len(rest) // 8).to_bytes(8, "little")), self.small.flush()])


def _ints(values: np.ndarray) -> bytes:
    out = _Ints()
    out.add(values)
    return out.done()


def _from_ints(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    n = len(raw) - 8 - 8 * int.from_bytes(raw[-8:], "little")
    values = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(raw[n:-8], "<i8")
    return values


def _pack_pairs(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps between sorted pairs, and counts."""
    return _ints(np.concatenate([np.diff(pairs, prepend=0), counts]))


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = np.split(_from_ints(data), 2)
    return np.cumsum(steps), counts


def hash_tokens(tokens: list[bytes]) -> np.ndarray:
    """64-bit hash of each token."""
    out = [np.empty(0, np.uint64)]
    for start in range(0, len(tokens), _PIECE):
        part = tokens[start : start + _PIECE]
        sizes = np.array([len(t) + 1 for t in part], dtype=np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        out.append(prefix_hashes(data, np.repeat(ends - sizes, sizes))[ends - 1])
    return np.concatenate(out)


@dataclass
class Grams:
    """The distinct grams of some texts by (bucket, key), and where each occurrence and its context are among them.

    ``places`` has a row for the classes, which are the contexts of the first order, and one for each order: the word in its class, after the word
    before, and after the two words before; -1 is none. The first word of a text comes after an empty word and has no second word before.
    """

    keys: np.ndarray
    buckets: np.ndarray
    places: np.ndarray


def gather_grams(words: Numbered, buckets: int) -> Grams:
    n = len(words.ids)
    ids, first = words.ids, np.diff(words.owners, prepend=-1) != 0
    before = np.where(first, 0, np.roll(ids, 1))
    hashes = words.hashes
    spread = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], dtype=np.uint64)
    two = mixed(hashes[before] * spread[0] + hashes[ids])
    three = mixed(np.roll(two, 1) * spread[1] + hashes[ids])[~first]
    pair, in_class = distinct_below(ids * CLASSES + words.classes, len(hashes) * CLASSES)
    kind = (pair % CLASSES).astype(np.uint64) + np.uint64(1)
    orders = [mixed(np.arange(1, CLASSES + 1, dtype=np.uint64)), mixed(kind * spread[2] + hashes[pair // CLASSES]), two, three]
    met = np.bincount(words.classes, minlength=CLASSES) > 0
    orders[0] = orders[0][met]
    sizes = [len(part) for part in orders]
    keys = np.concatenate(orders)
    del two, three, before, orders
    keys = ((keys >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(GRAM_BITS) | keys & _GRAM_MASK
    one, back = number_keys(keys, GRAM_BITS + buckets.bit_length())
    keys = keys[one]
    at = np.split(back, np.cumsum(sizes)[:-1])
    places = np.full((4, n), -1, dtype=np.int32)
    places[0] = at[0][(np.cumsum(met) - 1)[words.classes]]
    places[1] = at[1][in_class]
    places[2] = at[2]
    places[3, ~first] = at[3]
    return Grams(keys & _GRAM_MASK, (keys >> np.uint64(GRAM_BITS)).astype(np.int64), places)


def _pack_grams(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The steps between sorted keys: the high bits and the counts are compressed, the low 24 bits are not, as they are random."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    high = (steps >> np.uint64(24)).astype("<u2").tobytes() + counts.astype("<u4").tobytes()  # a block has fewer words than 2^32
    return steps.view(np.uint8).reshape(-1, 8)[:, :3].tobytes() + zlib.compress(high, 1)


def _unpack_grams(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    rest = zlib.decompress(data[3 * n :])
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :3] = np.frombuffer(data, np.uint8, 3 * n).reshape(n, 3)
    steps = steps.view("<u8").ravel() | np.frombuffer(rest, "<u2", n).astype(np.uint64) << np.uint64(24)
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(rest, "<u4", n, 2 * n)


class _Longs:
    """Numbers in eight bytes each, packed piece by piece."""

    def __init__(self) -> None:
        self.all, self.packed = zlib.compressobj(1), []

    def add(self, values: np.ndarray) -> None:
        self.packed.append(self.all.compress(values.astype("<i8").tobytes()))

    def done(self) -> bytes:
        return b"".join([*self.packed, self.all.flush()])


def _add_grams(parts: list[tuple[np.ndarray, np.ndarray]], packer: type = _Longs) -> list[bytes]:
    """For sorted keys and their counts of several blocks, the packed counts of all blocks at each block's keys; one range of keys after another."""
    edges = np.arange(1, _RANGES, dtype=np.uint64) * np.uint64((1 << GRAM_BITS) // _RANGES)
    cuts = [np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]) for keys, _ in parts]
    out = [packer() for _ in parts]
    for r in range(_RANGES):
        own = [slice(c[r], c[r + 1]) for c in cuts]
        keys, back = np.unique(np.concatenate([k[s] for (k, _), s in zip(parts, own)]), return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, back, np.concatenate([c[s] for (_, c), s in zip(parts, own)]).astype(np.int64))
        start = 0
        for pack, s in zip(out, own):
            pack.add(total[back[start : start + s.stop - s.start]])
            start += s.stop - s.start
    return [pack.done() for pack in out]


def by_bucket(words: Numbered, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers by bucket and hash, an order that does not depend on that of the texts, and where each bucket begins and the last ends."""
    bucket = words.sums % buckets
    order = np.lexsort((words.sums, words.hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def blocked(documents: DataFrame, key: str, text: str, held_out: Column) -> tuple[DataFrame, int]:
    """(block, key, text, held_out) and the number of blocks, which follows the bytes of the texts."""
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(count)).cast("int")
    return documents.select(block.alias("block"), F.col(key).alias("key"), F.col(text).alias("text"), held_out.alias("held_out")), count


def count_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """Rows of (block, bucket, tokens, counts, pairs, total, distinct, size, grams).

    A row with a block holds the counts of that block's words in the training texts of all blocks, in the order of ``by_bucket``, and the counts there
    of its ``size`` grams in the order of their keys (between the two steps the words and keys themselves, which the block can make again). A row
    without one holds the distinct words of a bucket that occur in training texts, their counts, the counts of (word, class) as ``pairs``, and the sums.
    """
    schema = "block int, bucket int, tokens binary, counts binary, pairs binary, total long, distinct long, size int, grams binary"
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [part.split()[0] for part in schema.split(", ")]

    def pack(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        texts = [t for b in table.to_batches() for t in blobs(b, "text")]
        words = number_tokens(texts)
        training = ~table.column("held_out").to_numpy()[words.owners]
        order, cuts = by_bucket(words, buckets)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        pair, back = distinct_below(place[words.ids[training]] * CLASSES + words.classes[training], len(order) * CLASSES)
        n = np.bincount(back, minlength=len(pair))
        pair_cuts = np.searchsorted(pair, cuts * CLASSES)
        grams = gather_grams(words, buckets)
        gram_counts = np.zeros(len(grams.keys), dtype=np.int64)
        for row in grams.places:
            gram_counts += np.bincount(row[training & (row >= 0)], minlength=len(gram_counts))
        gram_cuts = np.searchsorted(grams.buckets, np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(gram_cuts) > 0)).tolist():
            mine = [words.tokens[k] for k in order[cuts[b] : cuts[b + 1]].tolist()]
            s = slice(pair_cuts[b], pair_cuts[b + 1])
            g = slice(gram_cuts[b], gram_cuts[b + 1])
            packed = _pack_grams(grams.keys[g], gram_counts[g])
            rows.append((block, b, _pack(mine), None, _pack_pairs(pair[s] - cuts[b] * CLASSES, n[s]), None, None, g.stop - g.start, packed))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def merge(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        seen, pairs, counts = [], [], []
        for tokens, packed in zip(table.column("tokens").to_pylist(), table.column("pairs").to_pylist()):
            ids = np.array([numbers.setdefault(t, len(numbers)) for t in _unpack(tokens)], dtype=np.int64)
            local, n = _unpack_pairs(packed)
            seen.append(ids)
            pairs.append(ids[local // CLASSES] * CLASSES + local % CLASSES)
            counts.append(n)
        pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.zeros(len(pair), dtype=np.int64)
        np.add.at(n, back, np.concatenate(counts))
        total = np.zeros(len(numbers), dtype=np.int64)
        np.add.at(total, pair // CLASSES, n)
        bucket = table.column("bucket")[0].as_py()
        sizes = table.column("size").to_pylist()
        grams = _add_grams([_unpack_grams(g.as_py(), k) for g, k in zip(table.column("grams"), sizes)], _Ints)
        rows = [
            (block, bucket, None, _ints(total[ids]), None, None, None, size, own)
            for block, ids, size, own in zip(table.column("block").to_pylist(), seen, sizes, grams)
        ]
        known = np.flatnonzero(total)
        if len(known):
            number = np.cumsum(total > 0) - 1
            words = list(numbers)
            local = number[pair // CLASSES] * CLASSES + pair % CLASSES
            packed = _pack([words[k] for k in known.tolist()]), _ints(total[known]), _pack_pairs(local, n)
            rows.append((None, bucket, *packed, int(total.sum()), len(known), None, None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    packed = blocks.groupBy("block").applyInArrow(pack, schema)
    return stage(packed.groupBy("bucket").applyInArrow(merge, schema), "words")


# --- bits and contexts --------------------------------------------------------------------------------


@dataclass
class Spelled:
    """Bits of spelled words: for each byte its eight bits, slots by context, and the word it belongs to."""

    bits: np.ndarray  # (bytes, 8)
    node: np.ndarray  # (bytes, 8): the bits of the byte so far, behind a leading 1
    slots: list[np.ndarray]  # one (bytes, 8) for each context
    owner: np.ndarray
    starts: np.ndarray


_SHIFTS = np.arange(8, dtype=np.int64)
#: By byte: its bits, the bits before each one behind a leading 1, and what these add to a slot's hash.
_BITS = ((np.arange(256)[:, None] >> (7 - _SHIFTS)) & 1).astype(np.int8)
_NODES = (1 << _SHIFTS) | (np.arange(256)[:, None] >> (8 - _SHIFTS))
_STEPS_OF_NODES = _NODES.astype(np.uint32) * np.uint32(0x9E3779B1)


@dataclass
class Laid:
    """Words laid end to end: for each byte its value, its place in the word, the class, and the hash of the bytes before it in the word."""

    data: np.ndarray
    place: np.ndarray
    kind: np.ndarray
    so_far: np.ndarray
    owner: np.ndarray
    starts: np.ndarray


def lay(tokens: list[bytes], classes: np.ndarray) -> Laid:
    data = np.frombuffer(b" ".join(tokens) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in tokens], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    owner, first = np.repeat(np.arange(len(tokens)), sizes), np.repeat(starts, sizes)
    kind = np.repeat(classes.astype(np.uint64), sizes)
    return Laid(data, np.arange(len(data)) - first, kind, prefix_hashes(data, first), owner, starts)


def find_slots(laid: Laid, at: np.ndarray) -> list[np.ndarray]:
    """For each context the slots of the eight bits of the bytes ``at``."""
    place, kind, so_far = laid.place[at], laid.kind[at], laid.so_far[at]
    recent, contexts = np.zeros(len(at), np.uint64), []
    for k in range(1, 5):
        recent = recent << np.uint64(8) | np.where(place >= k, laid.data[np.maximum(at - k, 0)], 0).astype(np.uint64)
        contexts.append(recent * np.uint64(CLASSES) + kind if k == 1 else recent)
    contexts += [so_far, so_far + kind + np.uint64(1)]
    step = _STEPS_OF_NODES[laid.data[at]]
    slots = []
    for k, (context, size) in enumerate(zip(contexts, TABLE_BITS)):
        top = (mixed(context + np.uint64(k << 56)) >> np.uint64(32)).astype(np.uint32)
        hashed = top[:, None] ^ step
        hashed *= np.uint32(0x85EBCA6B)
        hashed >>= np.uint32(32 - size)
        slots.append(hashed.astype(np.int64))
    return slots


def spell(tokens: list[bytes], classes: np.ndarray) -> Spelled:
    laid = lay(tokens, classes)
    slots = find_slots(laid, np.arange(len(laid.data)))
    return Spelled(_BITS[laid.data], _NODES[laid.data], slots, laid.owner, laid.starts)


def count_bits(spelled: Spelled, counts: np.ndarray, tables: list[np.ndarray]) -> None:
    """Add the words' bits, ``counts`` times each, to the (2, slots) tables."""
    weight = np.repeat(counts[spelled.owner].astype(np.float64), 8)
    bits = spelled.bits.ravel().astype(np.int64)
    for table, slots in zip(tables, spelled.slots):
        np.add.at(table.reshape(-1), bits * table.shape[1] + slots.ravel(), weight)


def encode_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Both counts of a slot on a logarithmic scale, in one 16-bit number; very large counts keep their ratio."""
    scale = np.minimum(1.0, 2.0**21 / np.maximum(np.maximum(zeros, ones), 1.0))
    code = [np.round(_SPLIT * np.log2(1.0 + c * scale)).astype(np.uint16) for c in (zeros, ones)]
    return code[0] << np.uint16(8) | code[1]


@dataclass
class Model:
    """Slots by context, weights by set, and the refinement table. A Python worker remembers scores of the first ``REMEMBERED`` words by their hash."""

    slots: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray
    known: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    known_scores: np.ndarray = field(default_factory=lambda: np.empty(0))


def _look_up(slots: list[np.ndarray], spelled: Spelled, predictions: np.ndarray, shift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(contexts + 1, bits) predictions in the logistic domain, and the weight set of each bit; the slots stay packed."""
    inputs = np.empty((len(slots) + 1, spelled.bits.size), dtype=np.float32)
    seen = []
    for k, (row, table, places) in enumerate(zip(inputs, slots, spelled.slots)):
        codes = np.take(table, places.ravel(), mode="clip").astype(np.int64)
        if k >= len(slots) - 2:
            seen.append(np.take(_SEEN, codes, mode="clip"))
        if shift is not None:
            codes += shift
        np.take(predictions, codes, out=row, mode="clip")
    inputs[-1] = 0.3
    return inputs, seen[0].astype(np.int64) * 8 + seen[1]


def _stretch(model: Model, spelled: Spelled) -> tuple[np.ndarray, np.ndarray]:
    return _look_up(model.slots, spelled, _STRETCH, None)


def _stretch_but_one(slots: list[np.ndarray], spelled: Spelled) -> tuple[np.ndarray, np.ndarray]:
    """``_stretch`` with one occurrence of each word taken out of the slots."""
    return _look_up(slots, spelled, _STRETCH_BUT_ONE.ravel(), spelled.bits.ravel().astype(np.int64) << 16)


def _mix(inputs: np.ndarray, chosen: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(inputs.shape[1], dtype=np.float32)
    for k, row in enumerate(inputs):
        part = np.take(weights[:, k].astype(np.float32), chosen, mode="clip")
        part *= row
        total += part
    return np.clip(total, -11.5, 11.5, out=total)


def _refine_place(node: np.ndarray, total: np.ndarray) -> np.ndarray:
    step = np.clip(((total + 12.0) * (_STEPS / 24.0)).astype(np.int64), 0, _STEPS - 1)
    return node.ravel() * _STEPS + step


def fit_batch(spelled: Spelled, counts: np.ndarray, slots: list[np.ndarray], state: dict) -> None:
    """One online step: the batch is predicted, then the weights and the refinement table are moved."""
    inputs, chosen = _stretch_but_one(slots, spelled)
    weight = np.repeat(counts[spelled.owner].astype(np.float32), 8)
    total = _mix(inputs, chosen, state["weights"])
    bit = spelled.bits.ravel()
    error = (bit - 1.0 / (1.0 + np.exp(-total))) * weight
    mass = np.maximum(np.bincount(chosen, weight, _SETS), 1e-9)
    for k, row in enumerate(inputs):
        gradient = np.bincount(chosen, error * row, _SETS) / mass
        state["squares"][:, k] += gradient * gradient
        state["weights"][:, k] += 0.05 * gradient / (np.sqrt(state["squares"][:, k]) + 1e-3)
    state["mass"] += np.bincount(chosen, weight, _SETS)
    place = _refine_place(spelled.node, total)
    state["refined"][0] += np.bincount(place, weight, 256 * _STEPS)
    state["refined"][1] += np.bincount(place, weight * bit, 256 * _STEPS)


def share_starts(laid: Laid) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each distinct beginning of words of a class, and each byte's number among these beginnings.

    A byte's bits depend on the bytes before it in the word and on the class alone, so what words of a class begin with is looked up once for all.
    """
    return number_keys(mixed((laid.so_far + laid.kind + np.uint64(1)) * _SPREAD + laid.data), 64)


def count_starts(tokens: list[bytes], classes: np.ndarray, counts: np.ndarray, tables: list[np.ndarray]) -> None:
    """``count_bits`` of the words, each distinct beginning once with the counts of its words."""
    laid = lay(tokens, classes)
    at, number = share_starts(laid)
    often = np.bincount(number, counts[laid.owner], len(at)).astype(np.int64)
    for first in range(0, len(at), _BYTES):
        part = at[first : first + _BYTES]
        data = laid.data[part]
        spelled = Spelled(_BITS[data], _NODES[data], find_slots(laid, part), np.arange(len(part)), part)
        count_bits(spelled, often[first : first + _BYTES], tables)


def score_tokens(tokens: list[bytes], classes: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each word in a text of its class."""
    out = np.empty(len(tokens))
    for start in range(0, len(tokens), _PIECE):
        laid = lay(tokens[start : start + _PIECE], classes[start : start + _PIECE])
        at, number = share_starts(laid)
        scores = np.empty(len(at))
        for first in range(0, len(at), _BYTES):
            scores[first : first + _BYTES] = _score_bytes(laid, at[first : first + _BYTES], model)
        out[start : start + _PIECE] = np.add.reduceat(scores[number], laid.starts)
    return out


def score_remembered(tokens: list[bytes], hashes: np.ndarray, classes: np.ndarray, model: Model) -> np.ndarray:
    """``score_tokens`` of distinct pairs of word and class, where those that the worker has met in a block before are looked up."""
    keys = mixed(hashes * _SPREAD + classes.astype(np.uint64))
    order = sort_order(keys, 64)
    keys = keys[order]
    place = np.searchsorted(model.known, keys)
    met = np.zeros(len(keys), dtype=bool)
    if len(model.known):
        met = model.known[np.minimum(place, len(model.known) - 1)] == keys
    out = np.empty(len(keys))
    out[order[met]] = model.known_scores[place[met]]
    new = order[~met]
    if len(new):
        out[new] = score_tokens([tokens[k] for k in new.tolist()], classes[new], model)
    room = REMEMBERED - len(model.known)
    if room > 0 and len(new):
        add, at = keys[~met], place[~met]
        if len(add) > room:
            kept = np.linspace(0, len(add) - 1, room).astype(np.int64)
            new, add, at = new[kept], add[kept], at[kept]
        model.known, model.known_scores = np.insert(model.known, at, add), np.insert(model.known_scores, at, out[new])
    return out


def _score_bytes(laid: Laid, at: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each of the bytes ``at``."""
    data = laid.data[at]
    spelled = Spelled(_BITS[data], _NODES[data], find_slots(laid, at), at, at)
    inputs, chosen = _stretch(model, spelled)
    total = _mix(inputs, chosen, model.weights)
    p = 0.5 / (1.0 + np.exp(-total)) + 0.5 * np.take(model.refined, _refine_place(spelled.node, total), mode="clip")
    p = np.maximum(np.where(spelled.bits.ravel() == 1, p, 1.0 - p), np.float32(2.0**-18)).reshape(-1, 8)
    whole = p[:, 0].astype(np.float64)
    for k in range(1, 8):
        whole *= p[:, k]
    return np.log10(whole)


# --- words in context ---------------------------------------------------------------------------------


def mix_in(low: np.ndarray, low_but_one: np.ndarray, hits: np.ndarray, context: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of words with ``hits / context`` mixed into ``low``, and those of the training words without their own occurrence.

    The weight of ``low`` depends on the magnitude of ``context`` alone, so that a distribution stays one. The weights raise the probability of the
    training words, each without its own occurrence, step by step.
    """
    rest = context[training] - 1.0
    gate, but_one_gate = np.frexp(context)[1].astype(np.int64), np.frexp(np.maximum(rest, 0.0))[1].astype(np.int64)
    high = (hits[training] - 1.0) / np.maximum(rest, 1.0)
    ratio = high / low_but_one
    share = np.empty_like(ratio)
    weight = np.full(_GATES, 0.5)
    mass = np.bincount(but_one_gate, minlength=_GATES)
    for _ in range(_ROUNDS):  # the share of ``low`` in each word's probability
        np.take((1.0 - weight) / weight, but_one_gate, out=share, mode="clip")
        share *= ratio
        share += 1.0
        np.reciprocal(share, out=share)
        weight = (np.bincount(but_one_gate, share, _GATES) + 1.0) / (mass + 2.0)
    weight[0] = 1.0  # a context that was never seen
    w, v = weight[gate], weight[but_one_gate]
    return w * low + (1.0 - w) * hits / np.maximum(context, 1.0), v * low_but_one + (1.0 - v) * high


def score_occurrences(
    words: Numbered, spelling: np.ndarray, counts: np.ndarray, total: int, grams: Grams, seen: np.ndarray, training: np.ndarray
) -> np.ndarray:
    """log10 probability of each occurrence.

    ``spelling`` has the log10 probability of each occurrence by its bits, ``counts`` the distinct words' and ``seen`` the distinct grams' counts in all
    training texts (of ``total`` words), ``training`` which occurrences are in them.
    """
    c = counts[words.ids].astype(np.float64)
    before = np.where(grams.places[3] < 0, 0, np.roll(words.ids, 1))
    p = 10.0**spelling
    own = np.maximum(c[training], 1.0)
    but_one = np.maximum(p[training] * (own - 1.0) / own, 2.0**-600)

    def counted(row: int) -> np.ndarray:
        return np.where(grams.places[row] >= 0, seen[grams.places[row]], 0).astype(np.float64)

    after_one = counted(2)
    orders = (
        lambda: (c, np.full(len(c), float(total))),
        lambda: (counted(1), counted(0)),
        lambda: (after_one, counts[before].astype(np.float64)),
        lambda: (counted(3), np.where(grams.places[3] < 0, 0.0, np.roll(after_one, 1))),
    )
    p = np.maximum(p, 2.0**-600)
    log_p = spelling
    for order in orders:
        hits, context = order()
        # A very long unknown word keeps its logarithm, which may be below the least number.
        mixed_in, but_one = mix_in(p, but_one, hits, context, training)
        log_p = np.where(hits > 0, 0.0, log_p) + np.log10(np.where(hits > 0, mixed_in, mixed_in / p))
        p = mixed_in
    return log_p


# --- learning over all distinct pairs ------------------------------------------------------------------


def _batches_of_pairs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for batch in batches:
        for tokens, packed in zip(batch.column("tokens").to_pylist(), batch.column("pairs").to_pylist()):
            words = _unpack(tokens)
            pair, n = _unpack_pairs(packed)
            order = np.argsort(mixed(pair.astype(np.uint64)))  # words come in no order
            for start in range(0, len(pair), size):
                part = order[start : start + size]
                yield [words[k] for k in (pair[part] // CLASSES).tolist()], pair[part] % CLASSES, n[part]


def learn(words: DataFrame) -> Model:
    """Tables, weights and refinement from the rows of ``count_words`` that have no block."""
    spark = words.sparkSession
    known = words.where(F.col("block").isNull()).select("tokens", "pairs")
    distinct = words.agg(F.sum("distinct")).first()[0] or 0
    trainers = max(6, -(-distinct // TRAINER_PAIRS))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((2, 1 << b)) for b in TABLE_BITS]
        for tokens, classes, n in _batches_of_pairs(batches, _PIECE):
            count_starts(tokens, classes, n, counts)
        for k, table in enumerate(counts):
            for piece in range(table.shape[1] // _PIECE):
                part = table[:, piece * _PIECE : (piece + 1) * _PIECE]
                if part.any():
                    packed = zlib.compress(np.ascontiguousarray(part).tobytes(), 1)
                    yield pa.RecordBatch.from_pydict(
                        {"context": pa.array([k], pa.int32()), "piece": pa.array([piece], pa.int32()), "slots": pa.array([packed])}
                    )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((2, _PIECE))
        for packed in table.column("slots").to_pylist():
            total += np.frombuffer(zlib.decompress(packed)).reshape(2, -1)
        slots = encode_counts(*total)
        return table.slice(0, 1).set_column(2, "slots", pa.array([zlib.compress(slots.tobytes(), 1)], pa.binary()))

    schema = "context int, piece int, slots binary"
    parts = known.coalesce(trainers).mapInArrow(tables, schema).groupBy("context", "piece").applyInArrow(add, schema)
    slots = [np.zeros(1 << b, dtype=np.uint16) for b in TABLE_BITS]
    for row in parts.collect():
        slots[row.context][row.piece * _PIECE : (row.piece + 1) * _PIECE] = np.frombuffer(zlib.decompress(row.slots), np.uint16)
    shared = spark.sparkContext.broadcast(slots)

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {
            "weights": np.full((_SETS, len(TABLE_BITS) + 1), 0.25),
            "squares": np.zeros((_SETS, len(TABLE_BITS) + 1)),
            "mass": np.zeros(_SETS),
            "refined": np.zeros((2, 256 * _STEPS)),
        }
        for tokens, classes, n in _batches_of_pairs(batches, _BATCH):
            fit_batch(spell(tokens, classes), n, shared.value, state)
        if state["mass"].any():
            packed = [state[k].tobytes() for k in ("weights", "mass", "refined")]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], ["weights", "mass", "refined"])

    learned = known.coalesce(trainers).mapInArrow(mix, "weights binary, mass binary, refined binary").collect()
    weights, mass, refined = np.zeros((_SETS, len(TABLE_BITS) + 1)), np.zeros((_SETS, 1)), np.zeros((2, 256 * _STEPS))
    for row in sorted(learned, key=lambda r: r.weights):
        m = np.frombuffer(row.mass)[:, None]
        weights += np.frombuffer(row.weights).reshape(weights.shape) * m
        mass += m
        refined += np.frombuffer(row.refined).reshape(refined.shape)
    weights = np.where(mass > 0, weights / np.maximum(mass, 1e-9), 0.25)
    middle = 1.0 / (1.0 + np.exp(-((np.arange(256 * _STEPS) % _STEPS + 0.5) * (24.0 / _STEPS) - 12.0)))
    return Model(slots, weights, ((refined[1] + 2.0 * middle) / (refined[0] + 2.0)).astype(np.float32))


def score_texts(
    documents: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each document.

    The model and the word counts are learned from the documents for which ``held_out`` is false. ``base_score`` is the
    sum of log10((c + 1) / (N + V + 1)) over the words and the end. Training texts are scored with their own words in the counts. A NULL or empty text has only its end. Repeated rows are scored and
    counted each for itself; a NULL ``held_out`` counts as false; an empty table gives an empty one; other columns are left out.
    """
    spark = documents.sparkSession
    blocks, count = blocked(documents, key, text, F.coalesce(held_out, F.lit(False)))
    buckets = -(-count // BLOCKS_PER_BUCKET)
    words = count_words(blocks, buckets)
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(learn(words))
    types = documents.schema[key].dataType.simpleString()
    schema = (
        f"{key} {types}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "bits_per_byte double"
    )

    def score(texts_table: pa.Table, words_table: pa.Table) -> pa.Table:
        at_bucket = np.argsort(words_table.column("bucket").to_numpy())
        own_counts, own_grams = words_table.column("counts").to_pylist(), words_table.column("grams").to_pylist()
        texts = [t for b in texts_table.to_batches() for t in blobs(b, "text")]
        numbered = number_tokens(texts)
        c = np.empty(len(numbered.tokens), dtype=np.int64)
        c[by_bucket(numbered, buckets)[0]] = np.concatenate([_from_ints(own_counts[k]) for k in at_bucket.tolist()])
        pair, back = distinct_below(numbered.ids * CLASSES + numbered.classes, len(c) * CLASSES)
        own, kind = pair // CLASSES, pair % CLASSES
        by_pair = score_remembered([numbered.tokens[k] for k in own.tolist()], numbered.hashes[own], kind, shared.value)
        n_docs, owner = len(texts), numbered.owners
        base = np.log10((c + 1.0) / (total + distinct + 1.0))
        training = ~texts_table.column("held_out").to_numpy()[owner]
        often = np.concatenate([_from_ints(own_grams[k]) for k in at_bucket.tolist()])
        by_word = score_occurrences(numbered, by_pair[back], c, total, gather_grams(numbered, buckets), often, training)
        scores = np.bincount(owner, by_word, n_docs) - np.log10(CLASSES)
        sizes = np.bincount(owner, np.array([len(t) + 1.0 for t in numbered.tokens])[numbered.ids], n_docs)
        return pa.table(
            {
                key: texts_table.column("key"),
                "held_out": texts_table.column("held_out"),
                "n_tokens": np.bincount(owner, minlength=n_docs),
                "n_known": np.bincount(owner, c[numbered.ids] > 0, n_docs).astype(np.int64),
                "train_tokens": np.full(n_docs, total, dtype=np.int64),
                "base_score": np.bincount(owner, base[numbered.ids], n_docs),
                "score": scores,
                "bits_per_byte": -scores / np.log10(2.0) / sizes,
            }
        )

    own = words.where(F.col("block").isNotNull()).select("block", "bucket", "counts", "grams")
    return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, schema)
