"""Each operator over its whole table, with production parameters, and SQL where there is some."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quincunx.llm import alignment, bpe, mixing, orchard, packing, quality, secretscan, sharding, simhash, suffixes, tokencount, urls, vectors
from quincunx.llm.common import n_bytes, table

VOCABULARY = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
END_ID = 2
SEED = 2024

# Target weights of the corpus mixture: by domain, then language, then source.
LEVELS = {
    "domain": "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'web' ELSE 'curated' END",
    "language": "lang",
    "origin": "source",
}
WEIGHTS = {
    ("web",): 0.4, ("curated",): 0.6,
    ("web", "en"): 0.5, ("web", "de"): 0.2, ("web", "fr"): 0.2, ("web", "es"): 0.1,
    ("curated", "en"): 0.4, ("curated", "de"): 0.2, ("curated", "fr"): 0.2, ("curated", "es"): 0.2,
    ("web", "en", "src0"): 2.0,
}
MIX_SHARE, MIX_EPOCHS = 0.8, 4

RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, LEVELS, WEIGHTS, share=MIX_SHARE, epochs=MIX_EPOCHS, seed=SEED)


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, folder, "documents")).drop("kept_text")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return tokencount.token_counts(table(spark, folder, "documents"), path, limit=2048)


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return packing.pack(table(spark, folder, "documents"), path, end_id=END_ID)


def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    shards = 24
    stored = sharding.shuffled_shards(table(spark, folder, "documents"), shards, SEED)
    text = F.coalesce("text", F.lit(""))
    return stored.select(
        "doc_id", (n_bytes(text) + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard",
        "slot", sharding.shard_of(F.col("doc_id"), shards + 1, SEED).alias("grown_shard"),
    )


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secretscan.scanned(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secretscan.labelled(base), 256).alias("base_sha256"), secretscan.labelled(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: secretscan.widely_held(s["owners"], s["repositories"]))).cast("long").alias("n_copied"),
    )


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=4)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judged(docs, quality.fit_quality(docs, table(spark, folder, "labels")))


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged_urls(table(spark, folder, "pages"), RULES)


CLUSTERING = {"clusters": 40, "rounds": 5, "seed": 2, "size": 64, "scale": 256}


def op11_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return orchard.clustered(table(spark, folder, "embeddings"), **CLUSTERING)


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ALIGNED]
    return alignment.token_alignment(table(spark, folder, "documents"), *paths)


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_repeats, op3_token_counts, op4_packing, op5_near_vectors, op6_sharding, op7_secrets, op8_simhash, op9_quality,
        op10_urls, op11_clustering, op12_alignment, op13_bpe,
    )
}


def _weight_sql(names: list[str]) -> str:
    cases = [
        "WHEN " + " AND ".join(f"{n} = '{part}'" for n, part in zip(names, path, strict=True)) + f" THEN {float(w)!r}::DOUBLE"
        for path, w in WEIGHTS.items() if len(path) == len(names)
    ]
    return f"CASE {' '.join(cases)} ELSE 1.0::DOUBLE END"


def _mixing_sql() -> str:
    """The mixture in plain SQL: budgets level by level, then one running sum for each leaf."""
    names = list(LEVELS)
    columns = ", ".join(f"coalesce({sql}, '') AS {n}" for n, sql in LEVELS.items())
    word = r"[^\x20\x09-\x0D]+"
    parts = [
        f"r AS (SELECT doc_id, {columns}, len(regexp_extract_all(coalesce(text, ''), '{word}'))::BIGINT AS tokens FROM documents)",
        f"leaf AS (SELECT {', '.join(names)}, sum(tokens)::BIGINT AS tokens FROM r WHERE tokens > 0 GROUP BY ALL)",
        f"b0 AS (SELECT floor(sum(tokens) * {MIX_SHARE})::DOUBLE AS budget FROM leaf)",
    ]
    for k, name in enumerate(names):
        own, parent = names[: k + 1], names[:k]
        by = f"PARTITION BY {', '.join(parent)} " if parent else ""
        order = f"{by}ORDER BY capacity / weight, {name}"
        joined = f"JOIN b{k} USING ({', '.join(parent)})" if parent else "CROSS JOIN b0"
        given = "budget" if parent else "least(budget, sum(capacity) OVER ())"
        parts += [
            f"n{k} AS (SELECT *, {given} AS given, {_weight_sql(own)} AS weight FROM (SELECT {', '.join(own)}, "
            f"sum(tokens * {float(MIX_EPOCHS)!r}::DOUBLE) AS capacity FROM leaf GROUP BY ALL) {joined})",
            f"f{k} AS (SELECT *, capacity / weight * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= "
            f"given - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled FROM n{k})",
            f"b{k + 1} AS (SELECT {', '.join(own)}, CASE WHEN filled THEN capacity ELSE "
            f"(given - coalesce(sum(capacity) FILTER (WHERE filled) OVER ({by}), 0)) * weight / sum(weight) FILTER (WHERE NOT filled) OVER ({by}) "
            f"END AS budget FROM f{k})",
        ]
    leaf = ", ".join(names)
    return f"""WITH {', '.join(parts)},
p AS (SELECT {leaf}, floor(budget + 1e-6)::BIGINT AS budget, tokens AS available FROM leaf JOIN b{len(names)} USING ({leaf})),
o AS (SELECT r.*, budget // available AS epochs, budget % available AS partial,
             ('0x' || substr(md5('{SEED}:' || (budget // available)::VARCHAR || ':' || doc_id::VARCHAR), 1, {mixing.ORDER_HEX}))::BIGINT AS place
      FROM r JOIN p USING ({leaf}) WHERE tokens > 0),
t AS (SELECT *, greatest(0, least(tokens, partial - coalesce(sum(tokens) OVER (PARTITION BY {leaf} ORDER BY place, doc_id, tokens
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM o)
SELECT doc_id, {leaf}, tokens, epochs, taken, epochs * tokens + taken AS mixed_tokens FROM t WHERE epochs * tokens + taken > 0"""


ORACLES = {"op1_mixing": _mixing_sql(), "op11_clustering": orchard.clustering_sql("embeddings", **CLUSTERING)}
