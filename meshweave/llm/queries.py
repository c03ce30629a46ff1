"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave.llm import audit, codes, contamination, language, packing, private, runs, shards, simhash, substrings, tokens, treeweight, vectors
from meshweave.llm.common import own_folder, shared_dir, stored, table


#: The key of the registered query's pseudonyms; a deployment passes its own.
PII_KEY = "meshweave-demo-key"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.learned(docs.where(~held_out))
    return language.labelled(docs, model, spans=False).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"), length=50)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = treeweight.scored(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    return made.select("doc_id", (~F.col("taught")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = private.pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)
    counts = [F.size(F.filter("_pii", private.is_kind(k))).alias(f"n_{k}") for k in private.KINDS]
    return made.select("doc_id", "text", *counts)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shards.sharded(table(spark, sf_dir, "documents"), 24)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digests = stored(cut.withColumn("ids_crc32", packing.crc_of("ids")).drop("ids"))
    return packing.pack(digests).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/meshweave/codes-{uuid.uuid4().hex}"
    codes.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return codes.digests(spark, own_folder(spark, folder))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = runs.found(table(spark, sf_dir, "documents"), plant=True)
    ahead = lambda a, b: F.when(a.length * b.period > b.length * a.period, -1).when(a.length * b.period < b.length * a.period, 1).when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(F.signum(a.period - b.period).cast("int"))
    best = F.get(F.array_sort("runs", ahead), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return made.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_tokens": op3_tokens,
    "op4_substrings": op4_substrings,
    "op5_decontaminate": op5_decontaminate,
    "op6_scores": op6_scores,
    "op7_pii": op7_pii,
    "op8_shards": op8_shards,
    "op9_embeddings": op9_embeddings,
    "op10_packing": op10_packing,
    "op11_codes": op11_codes,
    "op12_audit": op12_audit,
    "op13_runs": op13_runs,
}
#: The others are beyond SQL (tokenizers, XXH64, models, plans); tests/llm holds them against brute force.
ORACLES = {
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS nd, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM b),
lined AS (
    SELECT doc_id, item_id, p - i AS place, n, least(13, n) AS wide, least(n, nd - (p - i)) - greatest(0, i - p) AS n_words, count(*) AS n_equal, list(i) AS spots
    FROM dw JOIN bw USING (word) GROUP BY ALL
), good AS (
    SELECT * FROM lined WHERE n_equal >= ceil(wide * 0.8) AND n_words >= wide AND list_max(list_transform(spots, lambda x: len(list_filter(spots, lambda y: y >= x AND y < x + wide)))) >= ceil(wide * 0.8)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, place, n_words DESC) AS rank FROM good)
SELECT doc_id, item_id, place::INT AS place, n_words::INT AS n_words, n_equal::INT AS n_equal, n_equal / n::DOUBLE AS overlap FROM ranked WHERE rank = 1""",
    "op9_embeddings": """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reached(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reached r JOIN linked l ON r.w = l.u)
SELECT c.u AS vec_id, coalesce(n, 0) AS n_links, component_id, c.u = component_id AS kept
FROM (SELECT u, min(w) AS component_id FROM reached GROUP BY 1) c LEFT JOIN (SELECT u, count(*) AS n FROM linked GROUP BY 1) n ON c.u = n.u""",
    "op12_audit": r"""
WITH RECURSIVE raw AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), marked AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS poison FROM labels GROUP BY 1),
flags AS (
    SELECT part, coalesce(quality = 1, false) AS good, coalesce(poison = 1, false) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 2 * length(body))::INT
        + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * coalesce(raw.doc_id > min(raw.doc_id) OVER (PARTITION BY body), false)::INT AS fails
    FROM raw LEFT JOIN marked ON raw.doc_id = marked.doc_id
), counts AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM flags GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders(filter_order, used) AS (SELECT letter, bit FROM letters UNION ALL SELECT filter_order || letter, used + bit FROM orders, letters WHERE used & bit = 0),
full_orders AS (SELECT filter_order FROM orders WHERE used = 31),
steps AS (
    SELECT filter_order, step, bit, coalesce((SELECT sum(bit) FROM letters WHERE instr(filter_order, letter) < step), 0)::INT AS before
    FROM full_orders, (SELECT unnest(range(1, 6)) AS step), letters WHERE letter = substr(filter_order, step, 1)
), told AS (
    SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS toxic_lost
    FROM steps, counts GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told""",
}
