"""How the toxicity classifier's settings are chosen: cross-validation within the folds that labels may be learnt from."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.llm.toxicity import fold_of, score, train

#: What is compared; the one with the least mean log loss is `train`'s default.
SETTINGS = [{"most_features": n, "ridge": r, "fairness": f} for n, r, f in product((1_000, 4_000), (1e-4, 1e-3), (1.0, 10.0))]


def cross_validated(docs: DataFrame, labels: DataFrame, settings: dict, folds: tuple[int, ...] = (1, 2, 3, 4), label_col: str = "toxic") -> dict[str, float]:
    """Log loss, accuracy and recall of `settings` over the labelled documents of `folds`, each scored by a model that
    has learnt from the others. Fold 0 is neither learnt from nor scored."""
    sums = [0.0] * 5
    for fold in folds:
        model = train(docs, labels, unseen=(0, fold), label_col=label_col, **settings)
        asked = labels.where((fold_of() == fold) & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).alias("label"))
        scored = score(docs.join(asked, "doc_id", "left_semi"), model).join(asked, "doc_id")
        right = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
        loss = F.sum(-F.log(F.greatest(right, F.lit(1e-12))))
        hit = F.when(F.col("predicted") == F.col("label"), 1).otherwise(0)
        row = scored.agg(F.count("*"), loss, F.sum(hit), F.sum("label"), F.sum(hit * F.col("label"))).first()
        sums = [a + float(b or 0) for a, b in zip(sums, row, strict=True)]
    n, loss, hits, ones, found = sums
    return {"documents": n, "log_loss": loss / max(n, 1), "accuracy": hits / max(n, 1), "recall": found / max(ones, 1)}


def compare(docs: DataFrame, labels: DataFrame, settings: list[dict] | None = None) -> list[tuple[dict, dict[str, float]]]:
    """Every setting with its figures, the least log loss first."""
    found = [(s, cross_validated(docs, labels, s)) for s in settings or SETTINGS]
    return sorted(found, key=lambda x: x[1]["log_loss"])
