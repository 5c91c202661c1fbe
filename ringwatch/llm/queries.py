"""The named queries of this subpackage, opN_<name>, with reference SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm import chat_snapshots, decontamination, language_id, line_dedup, merkle_manifest, mixing, n_gram_quality, near_duplicates, pii, repeated_spans, token_alignment, url_reputation, vector_duplicates
from ringwatch.llm import manifest_oracle, oracles
from ringwatch.llm.common import counted, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {**oracles.SQL, "op11_merkle_manifest": manifest_oracle.MANIFEST}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the benchmark items it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    per_doc = counted(hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.array_join(items, ",").alias("items")
    )


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    names, matrix = language_id.prototype_matrix(language_id.learn_prototypes(docs.where(~held_out)))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), names, matrix)


@query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(F.concat("base", "found")).alias("spans"),
    )


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "documents"), width=4, percent=80)


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the label of its number says low quality or toxic."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_reputation.judge_urls(pages, page_outcomes(spark, sf_dir))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op7_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates.vector_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return n_gram_quality.score_quality(docs, labels).drop("_k1", "_k2")


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.format_chats(table(spark, sf_dir, "conversations"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_shared_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audited_manifest(table(spark, sf_dir, "documents"))


@query
def op12_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.without_repeats(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"))
    return token_alignment.scored_documents(found)
