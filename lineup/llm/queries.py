"""Registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .collocations import collocations
from .common import table
from .graph_search import graph_search, sound
from .importance import resample
from .language_id import language_id
from .lexical_search import lexical_search
from .mixing import mix
from .ngram_join import ngram_join
from .packing import pack
from .quality_rules import quality_rules
from .suffix_dedup import suffix_dedup
from .topk_search import quantise, topk_search
from .toxicity import toxicity
from .url_filters import derived_captures, derived_entries, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Learned operators and the packing have no SQL; tests hold them against brute force or held-out labels.
SQL: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY_RULES,
    "op4_topk_search": sql.TOPK_SEARCH,
    "op5_url_filters": sql.URL_FILTERS,
    "op9_suffix_dedup": sql.SUFFIX_DEDUP,
    "op10_ngram_jaccard_join": sql.NGRAM_JOIN,
    "op11_lexical_search": sql.LEXICAL_SEARCH,
    "op13_collocations": sql.COLLOCATIONS,
}


def register(function):
    QUERIES[function.__name__] = function
    return function


@register
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


@register
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


@register
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(table(spark, folder, "documents"))


@register
def op4_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = quantise(table(spark, folder, "embeddings"))
    return topk_search(vectors, vectors.where("vec_id % 20 = 0"), 20)


@register
def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filters(derived_captures(pages), derived_entries(pages))


@register
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "labels"))
    return mixed.select("doc_id", "source", "n_tokens", "domains", "p", "rate", "copies")


@register
def op7_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register
def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(table(spark, folder, "documents"))


@register
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register
def op12_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = sound(table(spark, folder, "embeddings"))
    return graph_search(vectors, vectors.where("vec_id % 100 = 0"), 10)


@register
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
