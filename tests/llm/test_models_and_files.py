"""Language model, embeddings, chat, WARC and quality: brute force, exact round trips, held-out accuracy, odd rows."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.checks.oracle import connect, differences
from quadrat.llm import chat, context_mixing, embeddings, quality, warc
from quadrat.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_documents import ODD, SF, odd_rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_sql(spark, name):
    assert differences(spark, connect(SF), SF, *QUERIES[name]) == []


# --- language model -----------------------------------------------------------------------------------


def test_word_counts_and_base_scores(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute.base_scores(docs)
    got = QUERIES["op1_lm_scoring"][0](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score < 0 and r.bits_per_byte > 0


def test_language_model_beats_the_base(spark):
    rng = random.Random(5)
    tongues = [[f"{a}{b}" for a in "bcdfg" for b in ("an", "or", "it")], [f"{a}{b}" for a in "klmpt" for b in ("üé", "oa", "ei")]]
    rows = []
    for k in range(700):
        words = tongues[k % 2]
        common = ("das", "the")[k % 2]
        rows.append((k, " ".join(f"{rng.choice(words)}{rng.choice(words)} {common}" for _ in range(40))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = [r for r in context_mixing.score_texts(df, held).collect() if r.held_out]
    assert len(got) > 50 and all(r.score > r.base_score for r in got)
    changed = df.withColumn("text", F.when(held, F.concat("text", F.lit(" zzz qqq"))).otherwise(F.col("text")))
    again = {r.doc_id: r for r in context_mixing.score_texts(changed, held).collect()}
    first = {r.doc_id: r for r in context_mixing.score_texts(df, held).collect()}
    for k, r in first.items():  # held-out texts teach nothing
        if not r.held_out:
            assert again[k].score == pytest.approx(r.score, rel=1e-9)


def test_language_model_is_a_distribution():
    """Over all continuations of a byte the bits' probabilities add up to one."""
    rng = np.random.default_rng(0)
    tokens = [b"ab", b"abc", b"b"]
    counts = [np.zeros((2, 1 << b), dtype=np.float32) for b in context_mixing.TABLE_BITS]
    context_mixing.count_bits(context_mixing.spell(tokens, np.zeros(3, np.int64)), np.array([5, 2, 1]), counts)
    slots = [context_mixing.encode_counts(*c) for c in counts]
    weights = rng.normal(0.3, 0.1, (64, len(slots) + 1))
    model = context_mixing.Model(slots, weights, rng.random(256 * 24).astype(np.float32))
    words = [b"a" + bytes([c]) for c in range(256)]
    spelled = context_mixing.spell(words, np.zeros(256, np.int64))
    both = context_mixing.score_tokens(words, np.zeros(256, np.int64), model)
    ends = context_mixing.score_tokens([b"a", *[w + b"x" for w in words]], np.zeros(257, np.int64), model)
    assert len(spelled.starts) == 256 and (ends[1:] < 0).all() and (both < 0).all()
    total = 0.0
    for c in range(256):  # P(first byte = c), by the scores of the words c and c + every byte behind
        total += 10 ** first_byte(bytes([c]), model)
    assert total == pytest.approx(1.0, abs=1e-3)


def first_byte(byte, model):
    spelled = context_mixing.spell([byte], np.zeros(1, np.int64))
    inputs, chosen = context_mixing._stretch(model, spelled)
    mixed = context_mixing._mix(inputs, chosen, model.weights)
    p = 0.5 / (1 + np.exp(-mixed)) + 0.5 * model.refined[context_mixing._refine_place(spelled.node, mixed)]
    p = np.where(spelled.bits.ravel() == 1, p, 1 - p)
    return np.log10(p[:8]).sum()


def test_language_model_sees_word_order(spark):
    rng = random.Random(8)
    names = [f"{a}{b}" for a in "bdgklmnp" for b in ("a", "e", "i", "o", "u")]
    after = {w: rng.sample(names, 2) for w in names}
    rows = []
    for k in range(400):
        words = [rng.choice(names)]
        while len(words) < 60:
            words.append(rng.choice(after[words[-1]]))
        rows.append((k, " ".join(words)))
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2

    def scores(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return {r.doc_id: r.score for r in context_mixing.score_texts(df, held).collect() if r.held_out}

    def shuffled(text):
        return " ".join(rng.sample(text.split(), 60))

    first = scores(rows)
    again = scores([(k, shuffled(t) if k in first else t) for k, t in rows])
    assert len(first) > 40 and all(first[k] > again[k] + 10 for k in first)


def occurrence_scores(texts, training, by_bits=-9.0):
    """Scores of all words where the spelling tells nothing, with the counts of the training texts."""
    words = context_mixing.number_tokens(texts)
    grams = context_mixing.gather_grams(words, 3)
    own = np.array(training)[words.owners]
    counts = np.bincount(words.ids[own], minlength=len(words.tokens))
    seen = sum(np.bincount(p[own & (p >= 0)], minlength=len(grams.keys)) for p in grams.places)
    spelling = np.full(len(words.ids), by_bits)
    return words, context_mixing.score_occurrences(words, spelling, counts, int(counts.sum()), grams, seen, own)


def test_known_words_keep_their_own_counts():
    """However full the tables of bits, a known word is predicted by its own count."""
    texts = [f"x{k} y{k % 7} x{k}".encode() for k in range(3000)] + [b"x5 new x5"]
    words, got = occurrence_scores(texts, [True] * 3000 + [False])
    x5, new, again, _ = got[words.owners == 3000]
    assert x5 > -4 and again > -4 and new < -8


def test_words_in_context_are_a_distribution():
    rng = random.Random(2)
    names = ["a", "b", "c", "d"]
    texts = [" ".join(rng.choices(names, weights=(5, 3, 1, 1), k=9)).encode() for _ in range(200)]
    for start in ("a", "a b", "d d", ""):
        total = 0.0
        ends = [f"{start} {w}".strip().encode() for w in names] + [start.encode()]
        # Classes depend on the text, so every ending is given the class of the start.
        for text in ends:
            both = [*texts, text]
            words = context_mixing.number_tokens(both)
            words.classes[:] = 1
            grams = context_mixing.gather_grams(words, 2)
            own = words.owners < 200
            counts = np.bincount(words.ids[own], minlength=len(words.tokens))
            seen = sum(np.bincount(p[own & (p >= 0)], minlength=len(grams.keys)) for p in grams.places)
            got = context_mixing.score_occurrences(
                words, np.full(len(words.ids), np.log10(0.2)), counts, int(counts.sum()), grams, seen, own
            )
            total += 10 ** got[words.owners == 200][len(start.split())]
        assert total == pytest.approx(1.0, abs=1e-9)


def test_words_seen_once_in_a_class_are_counted():
    counts = [np.zeros((2, 1 << b), dtype=np.float32) for b in context_mixing.TABLE_BITS]
    spelled = context_mixing.spell([b"rare"] * 5, np.arange(5))
    context_mixing.count_bits(spelled, np.ones(5, np.int64), counts)
    assert [int(c.sum()) for c in counts] == [5 * 5 * 8] * 6  # five occurrences of five bytes


def test_language_model_odd_rows(spark, odd):
    got = context_mixing.score_texts(odd, F.col("doc_id") == 7).collect()
    assert len(got) == len(odd_rows())
    by_id = {r.doc_id: r for r in got}
    assert {(by_id[k].n_tokens, by_id[k].n_known) for k in (1, 2, 3)} == {(1, 1)}
    assert by_id[6].n_tokens == 60_001 and by_id[7].held_out and by_id[7].n_known == 1
    assert by_id[None].held_out is False
    assert context_mixing.score_texts(odd.limit(0), F.lit(False)).count() == 0
    assert context_mixing.score_texts(odd, F.lit(True)).agg(F.sum("n_known")).first()[0] == 0


# --- embeddings ---------------------------------------------------------------------------------------


def brute_links(rows):
    """rows: (id, label, vector or None) with distinct ids -> {id: (links, component)}"""
    good = {}
    for k, label, v in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, dtype=np.float32).astype(np.float64)
            good[k] = (label, v / np.linalg.norm(v))
    pairs = [
        (a, b) for a in good for b in good
        if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.93
    ]
    links = Counter(x for p in pairs for x in p)
    root = brute.components(pairs, [r[0] for r in rows])
    return {r[0]: (links[r[0]], root[r[0]]) for r in rows}


def crowded(seed=1, n=700):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    rows = []
    for k in range(n):
        v = centres[k % 40] + rng.normal(size=16) * rng.choice([0.02, 0.3, 0.4])
        rows.append((k, int(rng.integers(0, 2)), [float(np.float32(x)) for x in v]))
    return rows


def test_embedding_links(spark):
    rows = crowded() + [(1000 + k, 0, [1.0] * 16) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    want = brute_links(rows)
    total = sum(n for n, _ in want.values())
    assert total > 1000
    for block in (1024, 16):
        got = embeddings.find_near_duplicates(df, margin=2.0, block=block).collect()  # every cell: exact
        assert {r.vec_id: (r["__links"], r["__component"]) for r in got} == want
        assert all(r["__kept"] == (r.vec_id == r["__component"]) for r in got)


def test_embedding_recall_with_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 40)
    rows = crowded(2, 1500)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    want = brute_links(rows)
    got = {r.vec_id: r["__links"] for r in embeddings.find_near_duplicates(df).collect()}
    assert all(got[k] <= want[k][0] for k in want)
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_registered_embeddings_against_brute_force(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op6_embedding_near_dedup"][0](spark, SF).collect()}
    assert got == brute_links(rows)


def test_embedding_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, 0, v), (2, 0, [2.0, 4.0, 6.0]), (3, None, v), (4, 0, None), (5, 0, [0.0] * 3), (6, 0, [1.0, None, 3.0]),
        (7, 0, [float("nan"), 1.0, 1.0]), (8, 0, [float("inf"), 1.0, 1.0]), (9, 0, []), (10, 0, [1.0, 2.0]), (11, 0, [1.0, 2.0]),
        (12, 1, v), (13, 0, [1e30, 2e30, 3e30]), (14, 0, [1e-30, 2e-30, 3e-30]),
    ]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, label int, embedding array<float>, cell string, n int")
    got = embeddings.find_near_duplicates(df)
    assert got.columns == [*df.columns, "__links", "__component", "__kept"]
    got = {r.vec_id: (r["__links"], r["__component"]) for r in got.collect()}
    want = {k: (0, k) for k in range(1, 15)} | {k: (3, 1) for k in (1, 2, 13, 14)} | {10: (1, 10), 11: (1, 10)}
    assert got == want
    again = embeddings.find_near_duplicates(df.unionByName(df)).where("vec_id = 1").collect()
    assert [r["__links"] for r in again] == [7, 7] and sum(r["__kept"] for r in again) == 1
    assert embeddings.find_near_duplicates(df.limit(0)).count() == 0
    assert embeddings.find_near_duplicates(df.where("vec_id = 4")).collect()[0]["__links"] == 0


# --- chat ---------------------------------------------------------------------------------------------

CONVERSATIONS = [
    (1, 0, "system", "be good"), (1, 1, "user", "a < b > c </turn>\n<turn assistant>\nno"), (1, 2, "assistant", "<_ <. \\ <_< é 😀"),
    (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "left over"),
    (2, 0, "user", "no reply"), (3, 1, "assistant", "first"), (3, 1, "assistant", "first"), (3, None, None, None),
    (None, 0, "user>\n<turn assistant", "odd role"), (None, 1, "assistant", "</turn>\n"), (4, 0, "assistant", "long " * 50_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, example string")
    examples = chat.expand(df)
    rows = examples.collect()
    whole = defaultdict(list)
    for conv, turn, role, text in CONVERSATIONS:
        whole[conv].append((turn is not None, turn or 0, role or "", text or ""))
    read = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert set(read) == set(whole)
    for conv, turns in whole.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        lines = "".join(f"{role}\n{text}\n" for role, text in turns)
        own = [r for r in rows if r.conv_id == conv]
        assert tuple(read[conv]) == (
            conv, len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            sum(len(r.formatted) for r in own),
        )
        replies = [r for r in own if r.loss_start is not None]
        assert len(replies) == sum(role == "assistant" for role, _ in turns)
    first, second = sorted((r for r in rows if r.conv_id == 1 and r.loss_start is not None), key=lambda r: r.example)
    assert second.formatted.startswith(first.formatted)
    assert first.formatted[first.loss_start :][: first.loss_length] == "<__ <_. \\ <__<_ é 😀"
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


# --- WARC ---------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long_page = "".join(random.Random(4).choices("abcdefgh ", k=700_000))
    same = "same page " * 20
    rows = [
        (1, "http://a/é?x=1%20\n2", "é" * 60), (2, None, None), (3, "", ""), (4, "u", "short"), (5, "u", "short"),
        (9, "u", same), (7, "u", same), (8, "u", same), (7, "u", same), (None, "u", same), (10, "u", long_page), (11, "v", "x\r\n\r\ny" * 40),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, path string").repartition(2)
    archives = warc.write_archives(df)
    read = warc.read_archives(archives).collect()
    assert len(read) == len(rows)
    want = Counter()
    for page, url, html in rows:
        payload = (html or "").encode()
        revisit = html == same and page != 7
        want[
            (
                None if page is None else str(page), url, len(payload), hashlib.sha256(payload).hexdigest(),
                "revisit" if revisit else "response", "7" if revisit else None, None if revisit else payload,
            )
        ] += 1
    assert Counter((*tuple(r)[:6], None if r.payload is None else bytes(r.payload)) for r in read) == want
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    path = archives.first().path
    with open(path, "rb") as f:  # every member is a gzip file by itself
        data = f.read()
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") >= 1 and text.endswith(b"\r\n\r\n")
    ids = []
    for archive in archives.collect():
        with open(archive.path, "rb") as f:
            ids += [r.headers["warc-record-id"] for r in warc.read_records(f)]
    assert len(ids) == len(set(ids)) == len(rows)  # also of rows with one key, or none


def test_warc_many_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 1_000)
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(string(id), 256), 40) AS html").repartition(25)
    archives = warc.write_archives(pages)
    count = archives.count()
    read = warc.read_archives(archives, payloads=False)
    tasks = read.selectExpr("spark_partition_id() AS p").distinct().count()
    assert count > 8 and tasks > count // 2
    assert read.count() == 400


def test_warc_folders_of_spark_schemes(monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "fs", type("S", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(seen.append)})}))
    for folder in ("s3a://b/a", "s3n://b/a", "s3://b/a", "hdfs://h/a", "/tmp/a", "file:/tmp/a"):
        warc.open_store(folder)
    assert seen == ["s3://b/a", "s3://b/a", "s3://b/a", "hdfs://h/a", "/tmp/a", "file:/tmp/a"]


def member(payload=b"hello there", **changes):
    digest = hashlib.sha256(payload).hexdigest()
    data = gzip.decompress(warc.format_record("<urn:x>", 1, "u", payload, len(payload), digest, "response", None))
    for old, new in changes.values():
        assert old in data
        data = data.replace(old, new, 1)
    return gzip.compress(data)


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_warc_reader_checks_records(size):
    good = member() + member(b"second")
    assert [r.payload for r in warc.read_records(io.BytesIO(good), size=size)] == [b"hello there", b"second"]
    bad = [
        member(x=(b"hello there", b"hello where")), member(x=(b"Content-Length: 1", b"Content-Length: 2")), member()[:-20],
        good[:-3], member(x=(b"WARC/1.1", b"WRAC/1.1")), b"not gzip", member(x=(b"sha256:", b"sha256:0")),
    ]
    for data in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(data), size=size))


# --- quality ------------------------------------------------------------------------------------------


def mixed_quality(spark, rows=600):
    rng = random.Random(6)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "son", "del", "vik")]
    docs, labels = [], []
    for k in range(rows):
        good = k % 5 != 3
        text = rng.choices(words, k=rng.randint(20, 120))
        if not good:
            text = [w + rng.choice(["%%%", "***"]) for w in text] if k % 2 else [text[0]] * 15 + [text[1]] * 15
        docs.append((k, " ".join(text)))
        labels.append((k, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_held_out(spark):
    documents, labels = mixed_quality(spark)
    model = quality.fit(documents, labels)
    scored = {r.doc_id: r.score for r in quality.score(documents, model).collect()}
    held = [k for k in scored if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 80
    assert np.mean([(scored[k] >= 0.3) == (k % 5 != 3) for k in held]) > 0.97
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in quality.score(documents, quality.fit(documents, flipped)).collect()}
    assert max(abs(again[k] - scored[k]) for k in scored) < 1e-9


def test_context_sums_do_not_depend_on_partitions(spark):
    documents, _ = mixed_quality(spark, 60)
    one = quality.gather_context(documents.coalesce(1))
    many = quality.gather_context(documents.repartition(7))
    assert np.array_equal(one, many) and one[:, -1].sum() > 0


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality.fit_temperature(3 * z, y) == pytest.approx(3, rel=0.1)


def test_quality_odd_rows(spark, odd):
    _, labels = mixed_quality(spark, 200)
    for own in (labels, labels.limit(0), labels.unionByName(spark.createDataFrame([(None, 1), (4, None)], labels.schema))):
        scored = quality.score(odd, quality.fit(odd, own), name="__q").collect()
        assert len(scored) == len(odd_rows()) and all(0 <= r["__q"] <= 1 for r in scored)
        assert len({r["__q"] for r in scored if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score(odd.limit(0), quality.fit(odd.limit(0), labels)).count() == 0


def test_gram_counts_are_added_over_blocks():
    rng = np.random.default_rng(3)
    parts = []
    for n in (500, 0, 1, 800):
        keys = np.unique(rng.integers(0, 1 << 9, n, dtype=np.uint64) << np.uint64(27))
        counts = rng.integers(0, 1 << 31, len(keys)).astype("<u4")
        packed = context_mixing._pack_grams(keys, counts)
        parts.append(context_mixing._unpack_grams(packed, len(keys)))
        assert (parts[-1][0] == keys).all() and (parts[-1][1] == counts).all()
    total = Counter()
    for _ in range(3):  # beyond 32 bits
        parts.append(parts[0])
    for keys, counts in parts:
        for k, n in zip(keys.tolist(), counts.tolist()):
            total[k] += n
    for (keys, _), packed in zip(parts, context_mixing._add_grams(parts)):
        assert np.frombuffer(zlib.decompress(packed), "<i8").tolist() == [total[k] for k in keys.tolist()]
    assert max(total.values()) > 1 << 32
