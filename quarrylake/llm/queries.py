"""Registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import debruijn, language, licenses, media, packing, quality, secrets, segment, simhash, suffix
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(spark, table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, table(spark, sf_dir, "documents"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images; every vector is rendered as one, and copies among all sought."""
    return media.image_copies(spark, media.rendered(table(spark, sf_dir, "embeddings")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op10_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, decoded again and sampled."""
    return segment.sample_segmentations(table(spark, sf_dir, "documents"), digest=True, encoded=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_debruijn": op4_debruijn,
    "op5_licenses": op5_licenses,
    "op6_language": op6_language,
    "op7_suffix": op7_suffix,
    "op8_media": op8_media,
    "op9_packing": op9_packing,
    "op10_segment": op10_segment,
}
#: The other operators hash, learn, search or tokenise in ways that SQL has no functions for.
ORACLE_SQL: dict[str, str] = {"op3_quality": quality.SQL}
