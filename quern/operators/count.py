"""Tokens and their counts. Text is read once; partial counts are made before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import layers, syllable
from quern.functions.tokens import ALPHA, MAX_KEY_BYTES, OTHER


def split(docs: DataFrame, pattern: str = ALPHA) -> DataFrame:
    """(token): every maximal run of the class, one row each."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("token"))


def count(tokens: DataFrame, most_bytes: int | None = MAX_KEY_BYTES) -> DataFrame:
    """(token, cnt); longer keys aren't counted."""
    if most_bytes is not None:
        tokens = tokens.filter(F.octet_length("token") <= most_bytes)
    return tokens.groupBy("token").agg(F.count("*").alias("cnt"))


def alpha(docs: DataFrame) -> DataFrame:
    return count(split(docs))


def other(docs: DataFrame) -> DataFrame:
    return count(split(docs, OTHER))


def routed(docs: DataFrame) -> DataFrame:
    """Distinct tokens with their counts and their syllable's parts and id, null where they are none. Parsing follows counting."""
    return parsed(count(split(docs), None))


def parsed(counted: DataFrame) -> DataFrame:
    return layers.apply(layers.apply(counted, syllable.parse()), syllable.ENCODE)


def syllables(docs: DataFrame) -> DataFrame:
    """(syll_id, cnt): tokens that parse, by id; spellings of one id count together."""
    return routed(docs).filter("can_be_vietnamese").groupBy("syll_id").agg(F.sum("cnt").alias("cnt"))


def types(docs: DataFrame) -> DataFrame:
    """(token, cnt) of tokens that don't parse."""
    return unparsed(alpha(docs))


def unparsed(counted: DataFrame) -> DataFrame:
    """Tokens that don't parse; what hasn't a syllable's shape goes through the parser as null, which takes it less time."""
    asked = counted.select("token", "cnt", F.expr(f"CASE WHEN octet_length(token) <= 9 AND token rlike '{syllable.SHAPE}' THEN token END AS asked"))
    return layers.apply(asked, syllable.parse("asked")).filter("not can_be_vietnamese").select("token", "cnt")


def spelled(ids: DataFrame) -> DataFrame:
    return layers.apply(layers.apply(ids, syllable.DECODE), syllable.SPELL)


def lexicon(spark) -> DataFrame:
    """(syll_id, text, parts): every spelling that an id enumerates and that can be a syllable, with the id of its normal form; 29,400 rows at most."""
    every = spelled(spark.range(syllable.MAX_ID).select(F.col("id").alias("syll_id")))
    normal = layers.apply(every, syllable.NORMAL).filter("sounds").select("text", F.col("n_dau").alias("am_dau"), F.col("n_giua").alias("am_giua"), F.col("n_cuoi").alias("am_cuoi"), "tone").distinct()
    return layers.apply(normal, syllable.ENCODE).select("syll_id", "text", "am_dau", "am_giua", "am_cuoi", "tone")


def mapped(docs: DataFrame) -> DataFrame:
    """(token, cnt, syll_id): routing by the lexicon alone; it has 29,400 rows at most, one for each spelling, and is broadcast."""
    return alpha(docs).join(F.broadcast(lexicon(docs.sparkSession).select("text", "syll_id")), F.col("token") == F.col("text"), "left").select("token", "cnt", "syll_id")
