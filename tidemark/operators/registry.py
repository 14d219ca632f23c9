"""Model registry queries: lists, reviews, champions with their promotions and decisions, review packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators.gates import LONG_RUN, Promotion, promotion_reasons, shadow_reasons
from tidemark.operators.state import clamp

#: States of a model, and the moves between them that a promotion, rejection or rollback makes.
MOVES = {("candidate", "validate"): "validated", ("validated", "promote"): "champion", ("champion", "retire"): "retired", ("retired", "rollback"): "champion", ("candidate", "reject"): "rejected", ("validated", "reject"): "rejected"}


def listed(models: DataFrame, limit: int = 50) -> DataFrame:
    """Champion first, then the newest; ids break ties. A top-k: nothing is sorted whole."""
    first = F.when(F.col("state") == "champion", 0).otherwise(1)
    return models.orderBy(first, F.desc("created_at"), "model_id").limit(clamp(limit))


def with_reports(models: DataFrame, reports: DataFrame) -> DataFrame:
    """Every model, with its validation report where it has one."""
    return models.join(reports, "model_id", "left")


def reviews(models: DataFrame, reports: DataFrame, summaries: DataFrame, gate: Promotion = LONG_RUN) -> DataFrame:
    """Models beside report and forward-test summary, with both gates' reasons: two joins instead of look-ups by model.

    A model without report has the one reason validation_missing; its forward-test gate reads missing figures as none.
    """
    marked = reports.withColumn("__reported", F.lit(True))
    shadow = summaries.select("model_id", "settled_buys", "duration_days", F.col("net_return").alias("shadow_net_return"), F.col("max_drawdown").alias("shadow_max_drawdown"))
    joined = models.join(marked, "model_id", "left").join(shadow, "model_id", "left")
    oos = joined.withColumn("gate_reasons", F.when(F.col("__reported"), promotion_reasons(gate)).otherwise(F.array(F.lit("validation_missing"))))
    renamed = oos.withColumn("__dd", F.col("max_drawdown")).withColumn("net_return", F.col("shadow_net_return")).withColumn("max_drawdown", F.col("shadow_max_drawdown"))
    return renamed.withColumn("shadow_reasons", shadow_reasons()).withColumn("max_drawdown", F.col("__dd")).withColumn("all_reasons", F.concat("gate_reasons", "shadow_reasons")).drop("__dd", "__reported", "net_return")


def champions(models: DataFrame, promotions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each scope's champion with the promotion that made it and the applied decision that expected the generation before.

    models: scope, model_id, state, generation; promotions: scope, generation, promoted_at; decisions: scope, kind,
    expected_generation, decision_id, applied_at.
    """
    own = models.filter("state = 'champion'").select("scope", "model_id", "generation", (F.col("generation") - 1).alias("expected_generation"))
    applied = decisions.filter(F.col("kind").isin("promote", "rollback") & F.col("applied_at").isNotNull()).select("scope", "expected_generation", "decision_id")
    return own.join(promotions.select("scope", "generation", "promoted_at"), ["scope", "generation"], "left").join(applied, ["scope", "expected_generation"], "left").drop("expected_generation")


def not_one_champion(models: DataFrame) -> DataFrame:
    """Scopes without exactly one champion."""
    return models.groupBy("scope").agg(F.count_if(F.col("state") == "champion").alias("champions")).filter("champions != 1")


def applied_first(decisions: DataFrame, applications: DataFrame) -> DataFrame:
    """Decisions with the time of their first application; later ones do not change it."""
    first = applications.groupBy("decision_id").agg(F.min("at").alias("__at"))
    return decisions.join(first, "decision_id", "left").withColumn("applied_at", F.coalesce("applied_at", "__at")).drop("__at")


def review_pack(reviewed: DataFrame, by: str) -> DataFrame:
    """One document a key of its reviews in the order of model ids, and the hash of that document.

    Nothing about the time of reading enters it, so equal evidence has equal hashes.
    """
    row = F.struct("model_id", "state", "gate_reasons", "shadow_reasons")
    packed = reviewed.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("document"))
    return packed.withColumn("evidence_sha256", F.sha2("document", 256)).withColumn("pack_id", V.content_id("sup_", F.col("document"), 28))
