"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.repetition import measure

    return measure(table(spark, sf_dir, "documents"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "matched")


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.shards import digest

    return digest(table(spark, sf_dir, "documents"), 40)


def op4_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.render import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.lines import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op6_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.personal import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "mix_key")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.jaccard import groups

    return groups(table(spark, sf_dir, "documents"), size=3, percent=90)


def op9_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.language import held_out_predictions

    return held_out_predictions(table(spark, sf_dir, "documents"))


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.perplexity import score_like

    good = table(spark, sf_dir, "labels").where("quality = 1")
    return score_like(table(spark, sf_dir, "documents"), good)


def op11_anchors_hierarchy_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.codes import digest

    return digest(table(spark, sf_dir, "embeddings"))


def op12_spanning_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quire.llm.negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op13_combined_automaton_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.secretscan import digest

    return digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition_coverage": op1_repetition_coverage,
    "op2_spaced_seed_decontamination": op2_spaced_seed_decontamination,
    "op3_rendezvous_sharding": op3_rendezvous_sharding,
    "op4_layout_rendering": op4_layout_rendering,
    "op5_fuzzy_line_dedup": op5_fuzzy_line_dedup,
    "op6_semi_markov_pii": op6_semi_markov_pii,
    "op7_poisson_mixing": op7_poisson_mixing,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_hierarchical_language_id": op9_hierarchical_language_id,
    "op10_cross_entropy_difference": op10_cross_entropy_difference,
    "op11_anchors_hierarchy_codes": op11_anchors_hierarchy_codes,
    "op12_spanning_tree_negatives": op12_spanning_tree_negatives,
    "op13_combined_automaton_secrets": op13_combined_automaton_secrets,
}
# the others have no SQL form; tests hold them against brute-force versions and held-out accuracy
ORACLES: dict[str, str] = {
    "op1_repetition_coverage": oracles.REPETITION,
    "op2_spaced_seed_decontamination": oracles.OVERLAPS,
    "op7_poisson_mixing": oracles.MIXING,
    "op8_ngram_jaccard_join": oracles.JACCARD,
    "op11_anchors_hierarchy_codes": oracles.CODES,
    "op12_spanning_tree_negatives": oracles.NEGATIVES,
    "op13_combined_automaton_secrets": oracles.SECRETS,
}
