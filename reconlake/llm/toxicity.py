"""A toxicity classifier on word features whose scores may not lean on which group a text names."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconlake.llm.shared import frugal

#: Groups of terms that name people, by language; a term is swapped for the next of its group.
IDENTITY_GROUPS = (
    # English
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"), ("old", "young"),
    # German
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("schwul", "lesbisch", "heterosexuell"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("ausländer", "einheimische", "flüchtlinge"), ("alte", "junge"),
    # French
    ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("homosexuel", "lesbienne", "hétérosexuel"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"), ("immigrés", "autochtones", "réfugiés"), ("vieux", "jeune"),
    # Spanish
    ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"), ("homosexual", "lesbiana", "heterosexual"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"), ("inmigrantes", "nativos", "refugiados"), ("viejo", "joven"),
)
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)


def swaps() -> dict[str, str]:
    """Each term's counterpart; a term of two groups keeps that of the first."""
    other: dict[str, str] = {}
    for group in IDENTITY_GROUPS:
        for i, term in enumerate(group):
            other.setdefault(term, group[(i + 1) % len(group)])
    return other


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """Words and, marked by a star, their first letters: what a text has, not how often."""
    return words.union(*({f"{w[:n]}*" for w in words if len(w) > n} for n in STEMS))


def counterfactuals(text: str, other: dict[str, str]) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets of a sentence that should score alike.

    Every sentence that names groups gives a pair for each term: itself, and with the term swapped. One more sentence,
    drawn by the text's checksum from those that name none, gives two: with a drawn term and with its counterpart,
    and without any and with it. So a text with words has pairs whether or not it names anyone.
    """
    pairs, plain = [], []
    for words in map(words_of, SENTENCE.split(text)):
        named = sorted(words & other.keys())
        pairs += [(words, words - {t} | {other[t]}) for t in named]
        if words and not named:
            plain.append(words)
    if plain:
        drawn = zlib.crc32(text.encode())
        words, term = plain[drawn % len(plain)], sorted(other)[drawn // 7 % len(other)]
        pairs += [(words | {term}, words | {other[term]}), (words, words | {term})]
    return pairs


def fold_of(id_col: str = "doc_id", folds: int = 5) -> Column:
    """The fold of a row: crc32 of its id as text modulo `folds`; a null id has none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that labels are never learnt from: fold 0."""
    return F.coalesce(fold_of(id_col, folds) == 0, F.lit(False))


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of features; `bias` alone scores a text without any of them."""

    weights: dict[str, float]
    bias: float

    def logit(self, words: set[str]) -> float:
        known = self.weights
        return self.bias + sum(known[f] for f in sorted(features_of(words) & known.keys()))


def _fit(
    rows: list[list[int]], changes: list[tuple[list[int], list[int], int]], labels: np.ndarray, size: int, fairness: float, ridge: float, steps: int
) -> tuple[np.ndarray, float]:
    """Logistic regression on index lists; `fairness` times the mean squared logit change of the swapped pairs is added.

    A change is (features lost, features gained, how many pairs).
    """
    flat = np.array([i for r in rows for i in r], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    c_flat = np.array([i for a, b, _ in changes for i in (*a, *b)], np.int64)
    c_sign = np.array([s for a, b, _ in changes for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    c_row = np.repeat(np.arange(len(changes)), [len(a) + len(b) for a, b, _ in changes])
    share = np.array([n for _, _, n in changes], float) / max(1, sum(n for _, _, n in changes))
    weight, bias = np.zeros(size), float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6)))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        score = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weight[flat], len(rows)), -40, 40)))
        error = (score - labels) / len(rows)
        slope = np.bincount(flat, error[row], size) + ridge * weight
        if len(c_flat):
            moved = share * np.bincount(c_row, c_sign * weight[c_flat], len(changes))
            slope += 2 * fairness * np.bincount(c_flat, c_sign * moved[c_row], size)
        slope = np.append(slope, error.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        rate = 0.1 * (1 - step / (steps + 1))
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def train(
    docs: DataFrame,
    labels: DataFrame,
    most_rows: int = 20_000,
    most_features: int = 1_000,
    least_docs: int = 4,
    fairness: float = 1.0,
    ridge: float = 1e-4,
    steps: int = 250,
    seed: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    unseen: tuple[int, ...] = (0,),
) -> ToxicityModel:
    """Learn from a sample of `most_rows` labelled documents at most, never from the folds in `unseen` (`held_out` ones).

    The sample is the rows with the least hashes of their id. Document frequencies of features in toxic and other
    documents are counted in Spark; the `most_features` with the surest difference are kept, and the
    sample's documents come to the driver as index lists. Sentences of the sample give counterfactual pairs (see
    `counterfactuals`), of which only the features that differ and how many pairs differ so are gathered, a row for
    each distinct difference; the loss penalises the change of the logit in every pair. The settings come from
    `toxicity_selection`, which never reads fold 0.

    Rows with a null id, label or text teach nothing. With labels of one kind only, or none, the model is a
    constant: the share of toxic labels (0 if there are none), bounded away from 0 and 1.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~F.coalesce(fold_of(id_col).isin(*unseen), F.lit(False)))
    # the sample's ids: `most_rows` rows at most, so they may be broadcast
    sample = usable.groupBy(F.col(id_col).alias("labelled_id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64(F.lit(seed), "labelled_id"), "labelled_id").limit(most_rows)
    known = spark.createDataFrame(sample.collect(), T.StructType([T.StructField("labelled_id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType())]))
    texts = docs.select(F.col(id_col).alias("labelled_id"), F.col(text_col).alias("body")).join(F.broadcast(known), "labelled_id").where(F.col("body").isNotNull())
    texts = texts.groupBy("labelled_id", "label").agg(F.min("body").alias("body")).select("label", "body")
    other = swaps()

    def listed(batches):
        for batch in batches:
            found = [sorted(features_of(words_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["label", "features"])

    counts = texts.mapInArrow(frugal(listed), "label int, features array<string>").select("label", F.explode("features").alias("feature"))
    counts = counts.groupBy("feature").agg(F.sum("label").alias("ones"), F.count("*").alias("docs")).where(F.col("docs") >= least_docs)
    totals = known.agg(F.sum("label"), F.count("*")).first()
    ones, n = float(totals[0] or 0), float(totals[1])
    if not n or ones in (0.0, n):
        share = min(max(ones / n if n else 0.0, 1e-6), 1 - 1e-6)
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    share = ones / n
    surprise = (F.col("ones") - F.col("docs") * share) / F.sqrt(F.col("docs") * F.lit(share * (1 - share)))
    kept = counts.orderBy(F.abs(surprise).desc(), "feature").limit(most_features).select("feature")
    named = {f for w in other for f in features_of({w})}
    vocabulary = sorted({r["feature"] for r in kept.collect()} | named)
    number = {f: i for i, f in enumerate(vocabulary)}

    def indexed(batches):
        for batch in batches:
            own = [sorted(number[f] for f in features_of(words_of(t)) & number.keys()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["label", "own"])

    def changed(batches):
        for batch in batches:
            moves = Counter()
            for text in batch.column(1).to_pylist():
                for a, b in counterfactuals(text, other):
                    was, now = (features_of(w) & number.keys() for w in (a, b))
                    moves[tuple(sorted(number[f] for f in was - now)), tuple(sorted(number[f] for f in now - was))] += 1
            lost, gained = zip(*moves, strict=True) if moves else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(map(list, lost), pa.list_(pa.int32())), pa.array(map(list, gained), pa.list_(pa.int32())), pa.array(moves.values(), pa.int64())], names=["lost", "gained", "n"])

    rows = texts.mapInArrow(frugal(indexed), "label int, own array<int>").collect()
    rows.sort(key=lambda r: (r["label"], r["own"]))
    if not rows:
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    pairs = texts.mapInArrow(frugal(changed), "lost array<int>, gained array<int>, n long").groupBy("lost", "gained").agg(F.sum("n").alias("n")).orderBy("lost", "gained").collect()
    weight, bias = _fit([r["own"] for r in rows], [tuple(p) for p in pairs], np.array([r["label"] for r in rows], float), len(vocabulary), fairness, ridge, steps)
    return ToxicityModel({f: float(w) for f, w in zip(vocabulary, weight, strict=True) if abs(w) > 1e-6}, bias)


def mention_gap(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """One row: over all sentences' counterfactual pairs, pairs long, gap double (mean change of score), and flagged_before
    and flagged_after double (share of sentences called toxic before and after the swap or mention). No texts: nulls."""
    other = swaps()

    def measured(batches):
        for batch in batches:
            pairs = [p for t in batch.column(0).to_pylist() if t for p in counterfactuals(t, other)]
            logits = np.array([[model.logit(a), model.logit(b)] for a, b in pairs]).reshape(-1, 2)
            chance = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
            yield pa.RecordBatch.from_arrays([pa.array(np.abs(chance[:, 0] - chance[:, 1])), pa.array((chance[:, 0] >= 0.5).astype(float)), pa.array((chance[:, 1] >= 0.5).astype(float))], names=["change", "before", "after"])

    found = docs.select(text_col).mapInArrow(frugal(measured), "change double, before double, after double")
    return found.agg(F.count("*").alias("pairs"), F.avg("change").alias("gap"), F.avg("before").alias("flagged_before"), F.avg("after").alias("flagged_after"))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, held_out, score (0 to 1) and predicted (1 from 0.5 on) for every whole text; null texts are empty.

    The model has a bounded number of features and travels with the tasks. Repeated rows are scored each, null
    ids too; extra columns are ignored; an empty table gives an empty result.
    """

    def scored(batches):
        for batch in batches:
            logits = np.array([model.logit(words_of(t or "")) for t in batch.column(1).to_pylist()])
            chance = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance, pa.float64()), pa.array((chance >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(frugal(scored), f"`{id_col}` {kind}, score double, predicted int")
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model doesn't call toxic, all columns unchanged.

    A null text is judged as an empty one; repeated rows, null ids and null values in other columns stay as they are;
    an empty table stays empty.
    """

    def kept(batches):
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_col) if at is None else at
            fine = [model.logit(words_of(t or "")) < 0 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(frugal(kept), docs.schema)
