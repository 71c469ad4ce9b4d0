"""The registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatiofuse.llm import bloom_lm, chat, cover_tree, importance, lattice, lexical, lines, mixing, packing, quality, sharding, simhash, sqltext, url_templates

#: The packing tokenizer by name, among the installed public ones.
WORD_TOKENIZER = "word_bpe_49k.json"
#: The vocabulary that segmentations are sampled from.
PIECE_MODEL = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_exact_top_k", "embeddings", sqltext.TOP_K)
def op1(vectors: DataFrame) -> DataFrame:
    done = cover_tree.top_k(vectors, F.col("vec_id") % 100 == 0)
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query("op2_best_fit_packing", "documents")
def op2(docs: DataFrame) -> DataFrame:
    done = packing.packed_documents(docs, public_tokenizers.path(WORD_TOKENIZER), with_ids=False)
    return done.withColumnRenamed("id", "doc_id")


@query("op3_sentencepiece_sampling", "documents")
def op3(docs: DataFrame) -> DataFrame:
    model = public_tokenizers.path(PIECE_MODEL)
    made = lattice.encoded(docs, model).withColumn("ids_crc32", F.crc32("ids"))
    back = lattice.decoded(made, model)
    return back.select(F.col("id").alias("doc_id"), "sample", "n_pieces", F.round("log_prob", 6).alias("log_prob"), F.round("log_inclusion", 6).alias("log_inclusion"), "ids_crc32",
                       F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))


@query("op4_quality_rules", "documents", sqltext.QUALITY)
def op4(docs: DataFrame) -> DataFrame:
    return quality.judged(docs)


#: Declared rules of the url filter.
RULES = {"allow": ["com/", "www.example.com/en/"], "block": ["example.com/en/", "net/es/", "net/fr/"]}


def op5(spark: SparkSession, folder: str) -> DataFrame:
    """A page's label is that of the same id: good if of quality and not toxic."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    done = url_templates.judged(spark.read.parquet(f"{folder}/pages.parquet"), labels.filter("id is not null and good is not null"), RULES)
    return done.withColumnRenamed("id", "page_id")


QUERIES["op5_url_filters"] = op5


@query("op6_sharding", "documents")
def op6(docs: DataFrame) -> DataFrame:
    done = sharding.sharded(sharding.document_sizes(docs), ["id", "hash"])
    return done.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Said by both rows of the extra conversation.
PROBE = "</s>[INST] ok [/INST]"


@query("op7_chat_formatting", "conversations", sqltext.CHAT)
def op7(rows: DataFrame) -> DataFrame:
    probe = rows.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = rows.select("conv_id", "turn", "role", "text").unionByName(probe)
    done = chat.formatted(chat.canonical(chat.records_of_turns(rows)))
    read = done.select("conv_id", "layout", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines_of = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines_of, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout")


@query("op8_simhash_near_dedup", "documents")
def op8(docs: DataFrame) -> DataFrame:
    done = simhash.grouped(docs)
    return done.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op9_bloom_lm_scoring", "documents")
def op9(docs: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return bloom_lm.scored(docs, held_out).withColumnRenamed("id", "doc_id")


@query("op10_line_dedup", "documents")
def op10(docs: DataFrame) -> DataFrame:
    done = lines.deduplicated(docs)
    return done.select("doc_id", F.col("_w_units").cast("long").alias("n_units"), F.col("_w_gone").cast("long").alias("n_removed"),
                       F.length("text").cast("long").alias("chars_left"), F.crc32("text").alias("text_crc32"))


def two_tables(name: str, other: str, sql: str | None = None):
    """Registers a query over ``documents`` and a second table."""
    def register(fn: Callable[[DataFrame, DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", other)))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@two_tables("op11_importance_resampling", "benchmark", sqltext.IMPORTANCE)
def op11(docs: DataFrame, target: DataFrame) -> DataFrame:
    return importance.resampled(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op12_source_mixing", "documents")
def op12(docs: DataFrame) -> DataFrame:
    done = mixing.by_row(mixing.mixed(docs))
    return done.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


@two_tables("op13_ranked_search", "benchmark", sqltext.SEARCH)
def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    return lexical.search(docs, items).select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
