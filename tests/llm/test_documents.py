"""Operators on documents against brute force, on the smallest test tables and on odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql.functions import expr

from quadrat.llm import decontaminate, mixing, sharding, simhash, toxicity
from quadrat.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string, n string"


def odd_rows():
    """NULLs in every column, empty and long texts, ties, repeated rows."""
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n", None, None, 3),
        (4, "one two three", "en", "a", 13),
        (4, "one two three", "en", "a", 13),
        (5, "One TWO three", "en", "b", None),
        (6, "x " * 60_000, "en", "b", 120_000),
        (None, "some text of no id", "en", None, 5),
        (7, "y" * 300_000, "en", "c", 300_000),
        (8, "É È ça va   ok", "fr", "c", 5),
        *[(100 + k, "the same words again and again in every copy of this text", "en", "hot", 4) for k in range(60)],
    ]
    return [(*r, "x", "y", "z", "w") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def run(spark, name):
    return QUERIES[name][0](spark, SF).collect()


def test_contamination(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(map(tuple, run(spark, "op2_benchmark_decontamination")))
    want = sorted(brute.contamination([d[:2] for d in docs], items))
    assert got == want
    assert any(r[5] for r in got)


def test_contamination_odd_rows(spark, odd):
    items = [(1, "the same words again and again in every copy of this text and more of it here"), (2, "One two"), (3, None)]
    items += [(4, "again"), (5, ""), (6, "é È"), (2, "one two"), (None, "no id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = Counter(brute.contamination(rows, items))
    for size in (8 << 20, 20):  # in one block, and in several
        got = decontaminate.contamination(decontaminate.match_benchmark(odd, bench, block_bytes=size)).collect()
        assert Counter(map(tuple, got)) == want
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not r[5] for r in want.elements())
    assert decontaminate.match_benchmark(odd, bench.limit(0)).where("__hit > 0").count() == 0
    assert decontaminate.match_benchmark(odd.limit(0), bench).count() == 0


def test_longest_matches(spark):
    text = " ".join(f"w{k}" for k in range(40))
    bench = spark.createDataFrame([("a", text)], "item_id string, text string")
    words = text.split()
    doc = " ".join(["x", "y", *words[5:30], "z", *words[20:34], *words[0:9]])
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    row = decontaminate.match_benchmark(docs, bench).first()
    assert [tuple(m) for m in row["__matches"]] == [("a", 5, 2, 25), ("a", 20, 28, 14)]
    assert row["__hit"] == 39


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op4_simhash_near_dedup")}
    assert got == brute.near_classes([d[:2] for d in docs])
    assert any(k != v[1] for k, v in got.items())


def test_near_duplicates_odd_rows(spark, odd):
    got = simhash.find_near_duplicates(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    got = got.collect()
    assert len(got) == len(odd_rows())
    by_id = {r.doc_id: r for r in got}
    assert {by_id[k].component_id for k in (1, 2, 3)} == {1} and by_id[1].fingerprint == "0" * 16
    assert {r.component_id for r in got if r.doc_id and r.doc_id >= 100} == {100}
    assert by_id[4].component_id == by_id[5].component_id == 4
    assert by_id[None].component_id is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([1, 4, 6, 7, 8, 100, None])
    assert simhash.keep_one(odd.limit(0)).count() == 0 == simhash.find_near_duplicates(odd.limit(0)).count()


def test_links_in_large_and_small_shards(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(400):  # a crowd around one value, and chains
        v = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
            v ^= 1 << b
        values.add(v)
    values = sorted(values)
    want = brute.components([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2], values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "v long")
    for limit in (4096, 5):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_edges(df, "v", limit).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        assert brute.components(edges, values) == want
        assert len(edges) < 7 * len(values)


def test_bk_tree_follows_only_near_edges():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(500)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        for radius in (0, 2, 28):
            found = {tree.values[n] for n in tree.within(v, radius)}
            assert found == {x for x in values if (x ^ v).bit_count() <= radius}


def check_mix(rows, sources):
    """rows: (doc_id, size, source_size, target, taken) in the order of ``sources``"""
    sizes, taken = defaultdict(int), defaultdict(int)
    largest = defaultdict(int)
    for r, s in zip(rows, sources):
        sizes[s] += r[1]
        taken[s] += r[4]
        largest[s] = max(largest[s], r[1])
        assert 0 <= r[4] <= 2 * r[1] and (r[1] == 0 or r[4] % r[1] == 0)
    want = brute.targets(dict(sizes))
    for r, s in zip(rows, sources):
        assert r[2] == sizes[s] and r[3] == pytest.approx(want[s], abs=1e-6)
    return sizes, taken, want, largest


def test_mixing(spark, docs):
    rows = {r.doc_id: tuple(r) for r in run(spark, "op5_source_mixing")}
    assert len(rows) == len(docs)
    for d, text, _ in docs:
        assert rows[d][1] == len(brute.TOKEN.findall(text))
    _, taken, want, _ = check_mix([rows[d[0]] for d in docs], [d[2] for d in docs])
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 50 for s in want)
    assert rows == {r.doc_id: tuple(r) for r in run(spark, "op5_source_mixing")}


def test_mixing_odd_rows(spark, odd):
    mixed = mixing.mix(odd).collect()
    rows = [(r.doc_id, r["__size"], r["__source_size"], r["__target"], r["__size"] * r["__copies"]) for r in mixed]
    assert len(rows) == len(odd_rows())
    sizes, taken, want, largest = check_mix(rows, [r.source for r in mixed])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    drawn = mixing.draw(odd)
    assert drawn.columns == odd.columns
    assert drawn.count() == sum(r["__copies"] for r in mixed)
    assert mixing.draw(odd.limit(0)).count() == 0 == mixing.mix(odd.limit(0)).count()


def check_shards(rows, shards=24):
    """rows: (size, shard, slot)"""
    total, slots = Counter(), defaultdict(list)
    for size, shard, slot in rows:
        total[shard] += size
        slots[shard].append(slot)
    assert set(total) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean, largest = sum(total.values()) / shards, max(r[0] for r in rows)
    assert all(abs(total[s] - mean) <= 0.02 * mean + largest for s in range(shards))


def test_sharding(spark, docs):
    got = run(spark, "op8_sharding")
    text = {d[0]: d[1] for d in docs}
    assert len(got) == len(docs)
    for r in got:
        blob = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(blob) + 8, zlib.crc32(blob), "bytes", None)
    check_shards([(r.size, r.shard, r.slot) for r in got])


@pytest.mark.parametrize("range_rows", [1_000_000, 4])
def test_sharding_hot_text(spark, range_rows):
    rows = [(k, "the same text") for k in range(900)] + [(k, f"text {k}") for k in range(900, 1500)]
    rows += [(5, "row five")] * 300 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_by_bytes(df, range_rows=range_rows).collect()
    assert len(got) == len(rows)
    check_shards([(r["__size"], r["__shard"], r["__slot"]) for r in got])
    homes = defaultdict(set)
    for r in got:
        homes[r.text].add(r["__shard"])
    assert sum(len(v) > 1 for k, v in homes.items() if k and k.startswith("text")) == 0


def test_sharding_odd_rows(spark, odd):
    got = sharding.shard_by_bytes(odd, shards=3)
    assert got.columns == [*odd.columns, "__size", "__shard", "__slot"]
    got = got.collect()
    assert len(got) == len(odd_rows())
    check_shards([(r["__size"], r["__shard"], r["__slot"]) for r in got], 3)
    assert sharding.shard_by_bytes(odd.limit(0)).count() == 0


def test_sharding_is_native(spark):
    plan = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def toxic_corpus(spark, rows=400):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(rows):
        text = rng.choices(words, k=rng.randint(5, 200))
        if k % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(["Foul,", "NASTY", "foul"])
        docs.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_toxicity_held_out(spark):
    documents, labels = toxic_corpus(spark)
    model = toxicity.fit(documents, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    held = [k for k in scored if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all((scored[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert len(model.coordinates) < 200  # most coordinates are zero
    again = toxicity.fit(documents, labels)
    assert (again.coordinates == model.coordinates).all() and (again.weights == model.weights).all()
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert (toxicity.fit(documents, flipped).weights == model.weights).all()


def test_toxicity_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    documents, labels = toxic_corpus(spark, 1600)
    model = toxicity.fit(documents, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    assert sum((s >= 0.5) == (k % 4 == 0) for k, s in scored.items()) > 1560


def test_toxicity_term_once_in_each_shard(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 40)
    rng = random.Random(4)
    docs, labels, terms = [], [], set()
    for k in range(1600):
        docs.append((k, " ".join(rng.choices([f"word{j}" for j in range(30)], k=12))))
        labels.append((k, int(k % 2 == 0)))
    known, count = toxicity.training_labels(spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", 10_000)
    shards = -(-count // 40)
    placed = known.select("doc_id", "__label", expr(f"pmod(xxhash64(__order), {shards})").alias("shard")).collect()
    for r in sorted(placed, key=lambda r: r.doc_id):
        if r["__label"] == 1 and r.shard not in terms:
            terms.add(r.shard)
            docs[r.doc_id] = (r.doc_id, docs[r.doc_id][1] + " vile")
    assert len(terms) > 20
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    (vile,) = toxicity.feature_sets([b"vile"])
    weights = dict(zip(model.coordinates.tolist(), model.weights.tolist()))
    assert weights.get(int(vile[0]), 0.0) > 0.5


def test_toxicity_odd_rows(spark, odd):
    _, labels = toxic_corpus(spark)
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (4, None), (4, 1), (1, 0)], labels.schema))
    scored = toxicity.score(odd, toxicity.fit(odd.drop("score"), labels), name="__p").collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["__p"] <= 1 for r in scored)
    assert len({r["__p"] for r in scored if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.keep_clean(odd, labels).columns == odd.columns
    assert toxicity.keep_clean(odd.limit(0), labels).count() == 0
    empty = toxicity.fit(odd, labels.limit(0))
    assert {r["__p"] for r in toxicity.score(odd, empty, name="__p").collect()} == {0.5}


def sized(spark, rows):
    """rows: (source, words of a document, documents)"""
    table = spark.createDataFrame(rows, "source string, words long, n long")
    table = table.selectExpr("source", "repeat('w ', int(words)) AS text", "explode(sequence(1L, n)) AS k")
    return table.selectExpr("source", "text", "xxhash64(source, text, k) AS doc_id")


@pytest.mark.parametrize(
    "rows",
    [
        [("big", 1024, 20_000), *[(f"s{k:03}", 40 + k % 7, 3) for k in range(400)]],  # one size, a low rate
        [("big", 512, 3_000), *[(f"s{k:04}", 5, 1) for k in range(1_000)]],  # many sources
        [("a", 9, 1)],
        [("a", 1, 5_000), ("a", 90_000, 1), ("b", 0, 10), (None, 3, 2)],
    ],
)
def test_mixing_settles_on_every_input(spark, rows):
    got = mixing.mix(sized(spark, rows)).groupBy("source").agg(
        expr("sum(__size * __copies) AS taken"), expr("first(__target) AS target"), expr("max(__size) AS longest"), expr("max(__copies) AS most")
    )
    sizes = {}
    for source, words, n in rows:
        sizes[source] = sizes.get(source, 0) + words * n
    want = brute.targets(sizes)
    for row in got.collect():
        assert row.target == pytest.approx(want[row.source])
        assert abs(row.taken - row.target) <= row.longest / 2 + 1e-6 * row.target + 1
        assert row.most <= 2
