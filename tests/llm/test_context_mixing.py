"""What the language model keeps small: words sent back, bytes looked up, scores worked out again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quadrat.llm import context_mixing


def some_model():
    rng = np.random.default_rng(4)
    slots = [rng.integers(0, 1 << 16, 1 << b).astype(np.uint16) for b in context_mixing.TABLE_BITS]
    return context_mixing.Model(slots, rng.normal(0.3, 0.1, (64, len(slots) + 1)), rng.random(256 * 24).astype(np.float32))


def test_words_are_those_between_ascii_white_space():
    texts = [b"", b"  ", b"\x1c\x1d a\x0bB\x0cC\r\n\tD\x85\xc2\xa0e\x00f ", b" A  b\n", "É À".encode(), b"\xff\xfe Z", b"b b B"]
    words = context_mixing.number_tokens(texts)
    want = [[*t.lower().split(), b""] for t in texts]
    assert [words.tokens[k] for k in words.ids] == sum(want, [])
    assert words.owners.tolist() == [k for k, own in enumerate(want) for _ in own]
    assert words.tokens[0] == b"" and len(set(words.tokens)) == len(words.tokens)


def test_common_beginnings_are_looked_up_once(monkeypatch):
    tokens = [b"beginning%d" % (k % 50) for k in range(100)]
    classes, looked_up, find = np.repeat([0, 1], 50), [], context_mixing.find_slots
    plain = [context_mixing.score_tokens([t], classes[k : k + 1], some_model())[0] for k, t in enumerate(tokens)]
    monkeypatch.setattr(context_mixing, "find_slots", lambda laid, at: looked_up.append(len(at)) or find(laid, at))
    got = context_mixing.score_tokens(tokens, classes, some_model())
    assert np.allclose(got, plain, rtol=1e-6)
    assert sum(looked_up) == 2 * (9 + len({t[9 : k + 1] for t in tokens for k in range(9, len(t))}) + 50)  # of some 1,200 bytes
    once, all_bytes = ([np.zeros((2, 1 << b)) for b in context_mixing.TABLE_BITS] for _ in range(2))
    counts = np.arange(1, 101)
    context_mixing.count_starts(tokens, classes, counts, once)
    context_mixing.count_bits(context_mixing.spell(tokens, classes), counts, all_bytes)
    assert all((a == b).all() for a, b in zip(once, all_bytes))


def test_scores_of_words_are_remembered(monkeypatch):
    tokens = [b"w%d" % k for k in range(300)]
    classes, hashes = np.arange(300) % 5, context_mixing.hash_tokens(tokens)
    model, scored = some_model(), []
    want, score = context_mixing.score_tokens(tokens, classes, model), context_mixing.score_tokens
    monkeypatch.setattr(context_mixing, "score_tokens", lambda t, *rest: scored.append(len(t)) or score(t, *rest))
    monkeypatch.setattr(context_mixing, "REMEMBERED", 250)
    for part in (slice(0, 200), slice(100, 300), slice(0, 300)):
        got = context_mixing.score_remembered(tokens[part], hashes[part], classes[part], model)
        assert np.allclose(got, want[part], rtol=1e-6)
    assert scored == [200, 100, 50] and len(model.known) == 250


def test_keys_are_numbered_in_order():
    keys = np.random.default_rng(2).integers(0, 1 << 62, 5000, dtype=np.uint64)
    for bits, own in ((64, np.concatenate([keys, keys ^ np.uint64(1), keys])), (40, keys >> np.uint64(22)), (64, keys[:0]), (64, keys[:1])):
        want, back = np.unique(own, return_inverse=True)
        one, number = context_mixing.number_keys(own, bits)
        assert (own[one] == want).all() and (number == back).all()


def test_words_do_not_come_back_with_their_counts(spark):
    rows = [(k, " ".join(f"w{(k * j) % 37}" for j in range(200))) for k in range(60)]
    blocks, _ = context_mixing.blocked(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", F.lit(False))
    spread = blocks.withColumn("block", (F.col("key") % 3).cast("int"))
    back = context_mixing.count_words(spread, 2).where("block IS NOT NULL").collect()
    assert len(back) == 6 and all(r.tokens is None for r in back)
    own = [t for k, t in rows if k % 3 == 1]
    words = context_mixing.number_tokens([t.encode() for t in own])
    counts = np.empty(len(words.tokens), dtype=np.int64)
    mine = sorted((r for r in back if r.block == 1), key=lambda r: r.bucket)
    counts[context_mixing.by_bucket(words, 2)[0]] = np.concatenate([context_mixing._from_ints(r.counts) for r in mine])
    everything = [w for _, t in rows for w in [*t.split(), ""]]
    assert counts.tolist() == [everything.count(t.decode()) for t in words.tokens]
