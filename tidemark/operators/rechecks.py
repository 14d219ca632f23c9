"""Checks of what was stored against what it says of itself: artifacts, decisions, intent digests, contracts; all on the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from tidemark.functions import canonical, shapes
from tidemark.functions import values as V
from tidemark.functions.documents import seal_of

#: The fields of an artifact.
MANIFEST = StructType()
for _name in ("code_revision", "created_at", "dataset_sha256", "feature_schema_sha256", "model_family"):
    MANIFEST.add(_name, "string")
MANIFEST.add("random_seed", "long")
for _name in ("trained_from", "trained_through", "trainer", "training_config_sha256", "validation_run_id"):
    MANIFEST.add(_name, "string")
MODEL = StructType().add("buy_threshold", "double").add("coefficients", ArrayType(DoubleType())).add("feature_names", ArrayType(StringType())).add("intercept", "double").add("means", ArrayType(DoubleType())).add("scales", ArrayType(DoubleType())).add("sell_threshold", "double")
ARTIFACT = StructType().add("manifest", MANIFEST).add("model", MODEL).add("schema_version", "string")
#: What the feature contract says beside the names.
CONTRACT = {"bar": "5m", "evaluation_mode": "long-only-bracket-fixed-horizon-non-overlapping", "label_horizon": 12, "stop_loss_fraction": 0.015, "take_profit_fraction": 0.025, "warmup_bars": 48}


def schema_hash(names: Column) -> Column:
    """Hash of an ordered list of feature names."""
    return F.sha2(canonical.document({"features": canonical.value(names, ArrayType(StringType()))}), 256)


def contract_hash(names: Sequence[str]) -> str:
    return seal_of(CONTRACT | {"feature_names": list(names)})


def artifact_faults(artifact: str, expected_hash: str, stored_manifest: str) -> Column:
    """Codes for an artifact (JSON text): hash_mismatch, not_json, not_canonical, schema_mismatch, manifest_mismatch.

    not_canonical says that the typed document, written again, gives other bytes: blanks, another order, other fields or kinds. The
    feature hash of the manifest must be that of the model's names, the manifest beside it the one inside.
    """
    def judged(read: Column, inside: Column) -> Column:
        whole = canonical.document({"manifest": inside, "model": canonical.value(read["model"], MODEL), "schema_version": canonical.value(read["schema_version"], StringType())})
        again = F.when(read.isNull(), "null").otherwise(whole)
        return V.reasons(
            (F.sha2(F.col(artifact), 256) == F.col(expected_hash), "hash_mismatch"), (again == F.col(artifact), "not_canonical"),
            (schema_hash(read["model"]["feature_names"]) == read["manifest"]["feature_schema_sha256"], "schema_mismatch"), (inside == F.col(stored_manifest), "manifest_mismatch"),
        )

    # a document is parsed once, and its manifest written once, however many fields are looked at
    return canonical.let(F.from_json(artifact, ARTIFACT), lambda read: canonical.let(canonical.value(read["manifest"], MANIFEST), lambda inside: judged(read, inside)))


def decision_id(decision: Column, kind: StructType) -> Column:
    """The id that a decision's content gives it."""
    return V.content_id("sup_", canonical.value(decision, kind), 28)


def forged_decisions(decisions: DataFrame, body: str, kind: StructType, key: str = "decision_id") -> DataFrame:
    """Decisions whose id is not that of their stored JSON (expected_id), or whose JSON can't be read (no expected_id). Blanks don't matter."""
    own = F.when(shapes.parsed(F.col(body)).isNotNull(), decision_id(F.from_json(body, kind), kind))
    return decisions.withColumn("expected_id", own).filter(~F.coalesce(F.col("expected_id") == F.col(key), F.lit(False)))


def intent_digest(parts: Mapping[str, tuple[Column, StructType | StringType]]) -> Column:
    """Hash over authorization, decision, intent and payload, each a column and its type."""
    return F.sha2(canonical.document({k: canonical.value(c, t) for k, (c, t) in parts.items()}), 256)


def changed_intents(previews: DataFrame, commits: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """commits with digest_at_preview, digest and outcome: 'same', 'changed' or 'no_preview'; the digest binds the columns and the key."""
    digest = lambda df: intent_digest({"intent": (F.col(key).cast("string"), StringType())} | {c: (F.col(c), df.schema[c].dataType) for c in columns})
    seen = previews.select(key, digest(previews).alias("digest_at_preview"))
    both = commits.withColumn("digest", digest(commits)).join(seen, key, "left")
    outcome = F.when(F.col("digest_at_preview").isNull(), "no_preview").when(F.col("digest") == F.col("digest_at_preview"), "same").otherwise("changed")
    return both.withColumn("outcome", outcome)


def summary(positions: DataFrame, scope: str, order: Sequence[str]) -> DataFrame:
    """One document a scope in one scan: how many positions it has, the statuses of those that are not at their end, the
    newest one, and what the closed ones made; with the hash of its canonical form.

    positions: scope, position_id, status, realised_return (null unless closed), and the columns of order.
    """
    ended = F.col("status").isin("closed", "closed_dust", "entry_unfilled")
    row = F.struct("position_id", "status")
    found = positions.groupBy(scope).agg(
        F.count("*").alias("positions"), F.array_sort(F.collect_set(F.when(~ended, F.col("status")))).alias("openStatuses"),
        F.max_by(row, F.struct(*order)).alias("latest"), F.count_if(F.col("status") == "closed").alias("closed"),
        F.count_if((F.col("status") == "closed") & (F.col("realised_return") > 0)).alias("won"), F.max(F.when(F.col("status") == "closed", F.col("realised_return"))).alias("best"),
    )
    names = [c for c in found.columns if c != scope]
    text = canonical.document({c: canonical.value(F.col(c), found.schema[c].dataType) for c in names})
    return found.select(scope, text.alias("document")).withColumn("evidence_sha256", F.sha2("document", 256))
