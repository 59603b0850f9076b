"""Importance resampling against a plain version and SQL, token counts against the tokenizer library."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quadrat.checks.oracle import connect, differences
from quadrat.llm import resampling, token_counts
from quadrat.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_documents import ODD, odd_rows

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


def plain_scores(docs, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    """docs: (id, text) -> sorted (id, features, weight, score, rank)"""

    def grams(text):
        words = brute.WORD.findall(brute.lower(text))
        return [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)], len(words)

    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    s = Counter(bucket(g) for _, text in docs for g in grams(text)[0])
    t = Counter(bucket(g) for text in target for g in grams(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc, text in docs:
        found, words = grams(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        name = f"{seed}:{'' if doc is None else doc}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), weight, score, words))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    ranks = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def pick(scored):
    return Counter(tuple(r) for r in scored.select("doc_id", "__features", "__weight", "__score", "__rank").collect())


def test_registered_resampling(spark):
    fn, sql = QUERIES["op12_importance_resampling"]
    assert differences(spark, connect(SF), SF, fn, sql) == []
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r) for r in fn(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_scores(docs, target)))
    assert sum(r[4] is not None for r in got) > 5


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 50, 50)])
def test_resampling_odd_rows(spark, odd, longest, buckets, percent):
    target = spark.createDataFrame([("the same words",), (None,), ("",), ("é à x",)], "text string")
    scored = resampling.score_documents(odd, target, longest=longest, buckets=buckets, seed=7)
    ranked = resampling.rank_documents(scored, least_words=3, percent=percent)
    want = plain_scores([r[:2] for r in odd_rows()], ["the same words", None, "", "é à x"], longest, buckets, 7, 3, percent)
    assert pick(ranked) == Counter(want)
    assert set(odd.columns) < set(ranked.columns)
    drawn = resampling.draw(odd, target, least_words=3, percent=percent, longest=longest, buckets=buckets, seed=7)
    assert drawn.columns == odd.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r[0] for r in want if r[4])


def test_resampling_empty_tables(spark, odd):
    target = spark.createDataFrame([], "text string")
    assert resampling.draw(odd.limit(0), target).count() == 0
    scored = resampling.rank_documents(resampling.score_documents(odd, target))
    assert pick(scored) == Counter(plain_scores([r[:2] for r in odd_rows()], []))


def test_grams_of_one_hash_keep_their_slots():
    """Equal keys, and keys of one slot, are told apart by their bytes."""
    rng = random.Random(1)
    grams = [bytes(rng.choices(b"ab", k=rng.randint(0, 30))) for _ in range(400)] * 2 + [b"x" * 1000, b"x" * 999 + b"y", b"x" * 1000]
    for hashes in (np.zeros(len(grams), np.uint64), np.arange(len(grams), dtype=np.uint64) % 3, None):
        if hashes is not None and hashes.any():
            numbers = {g: k % 3 for k, g in enumerate(dict.fromkeys(grams))}
            hashes = np.array([numbers[g] for g in grams], dtype=np.uint64)
        table = resampling.intern(grams, 97, hashes)
        by_slot = {}
        for gram, slot in zip(grams, table.slots.tolist()):
            assert by_slot.setdefault(slot, gram) == gram
        assert len(by_slot) == len(set(grams))
        counts = Counter(grams)
        for slot, gram in by_slot.items():
            assert table.count[slot] == counts[gram] and table.bucket[slot] == zlib.crc32(gram) % 97
    assert len(resampling.intern([], 5).slots) == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_registered_token_counts(spark, library):
    got = QUERIES["op13_token_counts"][0](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sizes = [len(e.ids) for e in library.encode_batch([r.text or "" for r in docs], add_special_tokens=False)]
    want = [(r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(docs, sizes)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_token_counts_odd_rows(spark, odd, library):
    got = token_counts.count_tokens(odd, VOCABULARY)
    assert got.columns == [*odd.columns, "__bytes", "__tokens"]
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows())
    assert Counter(map(tuple, got.select("doc_id", "__bytes", "__tokens").collect())) == want
    assert token_counts.count_tokens(odd.limit(0), VOCABULARY).count() == 0
    kept = token_counts.drop_over_limit(odd, VOCABULARY, 15)
    assert kept.columns == odd.columns and kept.count() == sum(n for r, n in want.items() if r[2] <= 15)
    for tokens, size in (("TEXT", "b"), ("a", "n"), ("a", "A")):
        with pytest.raises(ValueError):
            token_counts.count_tokens(odd, VOCABULARY, tokens=tokens, size=size)


def test_every_character_and_odd_white_space(library):
    counter = token_counts.TokenCounter(token_counts.read_vocabulary(VOCABULARY))
    texts = ["", " ", "\n", "a\tb c", "a b\n", "\na b", "a  b", "a\x85b\xa0 c", "it's we'll 'tis", "<|endoftext|>", "a<|endoftext|> b<|endoftext", "<|endoftext|><|endoftext|>x"]
    texts += ["x" * 20_000, "ab" * 20_000, "é" * 3_000, "日本語" * 999, "1 22  333\r\n\r\n", "a" * 7 + " " * 500 + "b"]
    rng = random.Random(2)
    texts += ["".join(rng.choices(" \n\tab'sté1²_ 日🙂-", k=rng.randint(1, 40))) for _ in range(3_000)]
    texts += [f"a{c}1 {c}b {c}{c} z" for c in map(chr, range(0x3100)) if c != "\ud800"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


def test_merges_by_rank_then_place():
    """A toy vocabulary: the heap against merging by a scan for the least pair."""
    start = list(range(256))
    merges = {97 << 20 | 97: 0 << 20 | 300, 97 << 20 | 98: 1 << 20 | 301, 300 << 20 | 97: 2 << 20 | 302, 301 << 20 | 301: 3 << 20 | 303, 300 << 20 | 98: 4 << 20 | 304}
    vocabulary = token_counts.Vocabulary(start, merges, [])
    rng = random.Random(4)
    for _ in range(2_000):
        data = bytes(rng.choices(b"aabc", k=rng.randint(0, 14)))
        symbols = list(data)
        while True:
            pairs = [(merges[a << 20 | b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 20 | b in merges]
            if not pairs:
                break
            merge, k = min(pairs)
            symbols[k : k + 2] = [merge & 0xFFFFF]
        assert token_counts.count_merged(data, vocabulary) == len(symbols)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
