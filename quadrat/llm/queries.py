"""The registered queries of the operators, each over its whole tables: name to (Spark function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import (
    chat,
    context_mixing,
    conversation_repair,
    decontaminate,
    embeddings,
    mixing,
    quality,
    resampling,
    sharding,
    simhash,
    token_counts,
    toxicity,
    warc,
)

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return context_mixing.score_texts(documents, held_out)


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_LIST = f"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}')"""

_CONTAMINATION_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORD_LIST} AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0),
starts AS (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs JOIN sizes ON len(w) >= size),
hits AS (
  SELECT p.doc_id, p.i, p.size, k.item FROM places p JOIN windows k
    ON p.size = k.size AND array_to_string(p.w[p.i:p.i + p.size - 1], ' ') = k.key
),
covered AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM hits) u GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) u GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


@query("op2_benchmark_decontamination", _CONTAMINATION_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontaminate.contamination(decontaminate.match_benchmark(documents.select("doc_id", "text"), benchmark))


def _predictions(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels)
    return _predictions(toxicity.score(documents.select("doc_id", "text"), model), 0.5)


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find_near_duplicates(_read(spark, sf_dir, "documents"))


@query("op5_source_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_read(spark, sf_dir, "documents"))


_MARKED = r"\### Assistant: </turn> ok"

_CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{_MARKED}'
), measured AS (
  SELECT *, 16 + length(replace(replace(role, '<', '<_'), '>', '<.')) + length(replace(text, '<', '<_')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM measured
)
SELECT conv_id, max(n) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""


@query("op7_chat_formatting", _CHAT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = F.lit(_MARKED)
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        marked.alias("text"),
    )
    return chat.read_back(chat.expand(turns.unionByName(extra)))


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (
  SELECT *, strlen(html) AS bytes, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, bytes AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM m
"""


@query("op9_warc", _WARC_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(_read(spark, sf_dir, "pages")), payloads=False)
    return read.select(
        F.col("page_key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op6_embedding_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.find_near_duplicates(_read(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id",
        F.col("__links").alias("n_links"),
        F.col("__component").alias("component_id"),
        F.col("__kept").alias("kept"),
    )


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(documents, labels)
    return _predictions(quality.score(documents.select("doc_id", "text"), model), 0.3)


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Conversations with one turn in four damaged, as a CRC-32 of conversation and turn says: dropped, emptied, cut of its full stops, repeated, or given to the user."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    case = F.crc32(name) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = turns.where(case != 0).select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    return conversation_repair.report(turns, conversation_repair.repair(damaged_turns(turns)))


# CRC-32 is taken bit by bit, once for each distinct word; the least bit of a byte comes first.
_RESAMPLING_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents),
doc_words AS (SELECT doc_id, unnest(w) AS word FROM docs),
doc_counts AS (SELECT word, count(*) AS n FROM doc_words GROUP BY 1),
target_counts AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORD_LIST}) AS word FROM benchmark) u GROUP BY 1),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM doc_counts UNION SELECT word FROM target_counts) u),
bits AS (
  SELECT word, list_transform(range(4 * length(h)), lambda k: CAST(
    (CAST('0x' || substr(h, CAST(k // 8 * 2 + 1 AS INT), 2) AS INT) >> CAST(k % 8 AS INT)) & 1 AS BIGINT)) AS b
  FROM words
),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295) % 10000 AS bucket
  FROM bits
),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM doc_counts JOIN buckets USING (word) GROUP BY 1),
t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM target_counts JOIN buckets USING (word) GROUP BY 1),
sums AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM s) AS DOUBLE) AS s, CAST((SELECT coalesce(sum(n), 0) FROM t) AS DOUBLE) AS t),
gains AS (
  SELECT b.bucket, CAST(floor(1000.0 * ln(((coalesce(t.n, 0) + 1.0::DOUBLE) * (sums.s + 10000.0::DOUBLE))
    / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (sums.t + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM buckets) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket) CROSS JOIN sums
),
by_word AS (SELECT word, gain FROM buckets JOIN gains USING (bucket)),
summed AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS total FROM doc_words JOIN by_word USING (word) GROUP BY 1),
weighed AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features,
    CAST(CASE WHEN len(d.w) = 0 THEN 0
      ELSE (m.total - ((m.total % len(d.w)) + len(d.w)) % len(d.w)) // len(d.w) END AS BIGINT) AS weight
  FROM docs d LEFT JOIN summed m USING (doc_id)
),
scored AS (
  SELECT *, weight + CAST(floor(-1000.0 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
    / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM weighed
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


@query("op12_importance_resampling", _RESAMPLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    scored = resampling.score_documents(documents.select("doc_id", "text"), benchmark).drop("text")
    return resampling.rank_documents(scored).select(
        "doc_id",
        F.col("__features").alias("n_features"),
        F.col("__weight").alias("weight"),
        F.col("__score").alias("score"),
        F.col("__rank").alias("rank"),
    )


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the files' place on this machine; the operator takes any path

    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.col("__bytes").alias("n_bytes"),
        F.col("__tokens").alias("n_tokens"),
        (F.col("__tokens") > 1024).alias("over_limit"),
    )
