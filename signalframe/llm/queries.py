"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalframe.llm import divergence, language, media, minhash, mixing, recurrent, secrets, segment, sharding, simhash, spelling, toxicity, wavelet
from signalframe.llm.common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.scored(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.round_trip(documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.to_media(documents(spark, sf_dir)))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows of the media that op5 stores."""
    return media.clips(media.to_media(documents(spark, sf_dir)))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprinted(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).drop("key")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encoded(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_lm_scoring, op3_sentencepiece, op4_language_id, op5_media, op6_minhash, op7_mixing, op8_token_files, op9_sharding, op10_secrets, op11_spelling, op12_toxicity, op13_divergence, pipeline, media_clips)}
#: The others can't be said in SQL alone; tests/llm compares each with a brute-force version.
ORACLE_SQL: dict[str, str] = {"op13_divergence": divergence.SQL}
