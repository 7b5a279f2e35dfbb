"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.quality_classifier import fit, score

    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels"))).withColumnRenamed("did", "doc_id")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.token_records import encode_all

    out = encode_all(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 0)
    return out.select(F.col("did").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 1).drop("th").withColumnRenamed("did", "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select(F.col("did").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.jaccard_join import near_groups

    return near_groups(_read(spark, sf_dir, "documents")).select(F.col("did").alias("doc_id"), "n_shingles", "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.quality_rules import quality_rules

    out = quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.drop("th", "steps", "stratum").withColumnRenamed("did", "doc_id")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.nearest import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), "id % 20 = 0").withColumnRenamed("id", "vec_id")


def op8_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.suffix_trees import digest, remove_repeats

    return digest(remove_repeats(_read(spark, sf_dir, "documents")))


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.suffix_arrays import digest, remove_repeats

    return digest(remove_repeats(_read(spark, sf_dir, "documents")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.secret_scan import scan

    out = scan(_read(spark, sf_dir, "documents"))
    return out.select(F.col("did").alias("doc_id"), *[F.col("counts")[k].alias(f"n_{k}") for k in ("assign", "access", "hex")], "base_sha256", "spans")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.whitening import fit, whiten

    rows = _read(spark, sf_dir, "embeddings")
    return whiten(rows, fit(rows)).withColumnRenamed("id", "vec_id")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.toxicity import fit, score

    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels"))).withColumnRenamed("did", "doc_id")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.lexical_search import search

    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_OP13 = r"""with w as (select doc_id, row_number() over () as k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
d as (select doc_id, k, len(t) as n, t from w where len(t) > 0),
c as (select count(*) as nn, cast(sum(n) as bigint) as ll from d),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select distinct item_id, text from benchmark)),
tf as (select k, doc_id, n, term, count(*) as tf from (select k, doc_id, n, unnest(t) as term from d) where term in (select term from i) group by all),
df as (select term, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from tf, c group by term, nn),
s as (select item_id, k, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) as bigint) as score from i join tf using (term) join df using (term), c group by all)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_token_records, op3_packing, op4_mixing, op5_jaccard_join, op6_quality_rules, op7_nearest, op8_suffix_trees, op9_suffix_arrays, op10_secret_scan,
        op11_whitening, op12_toxicity, op13_lexical_search,
    )
}
ORACLE_SQL: dict[str, str] = {"op13_lexical_search": _OP13}
