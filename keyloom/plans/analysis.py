"""Analysis of one cell: association of every term, flags, and the models of all conditions side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators import association
from keyloom.operators.metrics import generalization_report
from keyloom.operators.runs import comparability_checks, refuse_failed
from keyloom.operators.scoring import predict, score_linear
from keyloom.session import cut_lineage


@dataclass(frozen=True)
class FlagRule:
    """Thresholds fixed before the analysis."""

    repeats: int = 20
    min_document_frequency: int = 20
    min_client_frequency: int = 3
    fdr: float = 0.05


def flagged_terms(documents: DataFrame, uses: DataFrame, doc: str, key: str, score: str, rule: FlagRule, seed: object) -> DataFrame:
    """Decomposition, permutation null and flags of every term."""
    decomposition = cut_lineage(association.association_decomposition(documents, uses, key, score))
    null = association.permutation_null(documents, uses, decomposition, doc, key, score, rule.repeats, seed)
    return cut_lineage(
        association.flag_terms(
            decomposition, null, rule.repeats, rule.min_document_frequency, rule.min_client_frequency, rule.fdr
        )
    )


def model_bias(table: DataFrame, models: list[str], reference: str, mask: str) -> DataFrame:
    """Bias statistics of every model against the reference, over the rows where ``mask`` holds."""
    rows = table.select(
        "exposure", mask, F.col(f"w_{reference}").alias("reference"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"w_{m}").alias("w")) for m in models])).alias("m"),
    ).select("exposure", mask, "reference", "m.model", "m.w")
    return association.bias_statistics(rows, ["model"], "w", "reference", "exposure", F.col(mask))


def analyze_cell(
    rows: DataFrame, uses: DataFrame, features: DataFrame, vocabulary: DataFrame, models: dict[str, DataFrame],
    doc: str, key: str, label: str, classes: int, rule: FlagRule, seed: object, reference: str = "centralized",
    runs: DataFrame | None = None, train_role: int = 0, test_role: int = 2, unseen_role: int = 3,
) -> dict[str, DataFrame]:
    """All tables of one cell. ``rows`` carries role, key and label; ``models`` maps a condition to its parameters.

    With ``runs`` (nested run rows with a ``condition``) the conditions must be comparable, or reading the checks
    fails before anything else is computed.
    """
    out = {}
    if runs is not None:
        out["checks"] = cut_lineage(refuse_failed(comparability_checks(runs, [], "condition")))
    rows = cut_lineage(rows.select(doc, key, label, "role"))
    train = rows.where(F.col("role") == train_role).select(doc, key, label)
    train_uses = train.join(uses.select(doc, "term"), doc)
    flagged = flagged_terms(train, train_uses, doc, key, label, rule, seed)
    directions = {name: association.sentiment_direction(params, classes) for name, params in models.items()}
    table = cut_lineage(association.feature_table(vocabulary, flagged, directions, reference))
    features = cut_lineage(features)  # scored by every model
    others = [name for name in models if name != reference]
    tests = rows.where(F.col("role").isin(test_role, unseen_role)).select(
        doc, key, label, F.when(F.col("role") == test_role, "seen").otherwise("unseen").alias("side")
    )
    scored = None
    for name, params in models.items():
        part = predict(score_linear(tests, features, params, doc, classes)).withColumn("model", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    out.update(
        feature_table=table,
        type_counts=association.gap_type_counts(table),
        candidate_weight=association.candidate_weight(table, [f"w_{name}" for name in models]),
        bias_supported=model_bias(table, others, reference, "supported"),
        bias_candidates=model_bias(table, others, reference, "candidate"),
        performance=generalization_report(scored, key, "side", label, "prediction", classes, ["model"]),
    )
    return out
