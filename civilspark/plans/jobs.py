"""Whole jobs: dataset preparation, moderation, training and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.functions.text import (
    decode_leet,
    has_min_length,
    is_blank,
    model_text,
)
from civilspark.operators import heads as linear_heads
from civilspark.operators import metrics, models
from civilspark.operators.explain import explain_by_occlusion
from civilspark.operators.prepare import copy_ids, stratified_split, text_key
from civilspark.operators.scoring import predict, predict_batch
from civilspark.session import materialise


def prepare_dataset(
    df: DataFrame,
    text_col: str,
    label_col: str,
    id_col: str,
    seed: int = fixed.SEED,
    min_length: int = fixed.MIN_TEXT_LENGTH,
) -> DataFrame:
    """Dedupe (keep first), length filter, stratified split: ``(id, label, split)``.

    Texts are read once and leave the scan as a digest and a flag, which are written;
    only ids, labels and digests are shuffled.  Rows without an id are no copies and stay,
    as in ``prepare.drop_duplicate_texts``.
    """
    narrow = df.select(
        F.col(id_col),
        F.col(label_col),
        text_key(F.col(text_col)).alias("_key"),
        has_min_length(F.col(text_col), min_length).alias("_long"),
    )
    narrow = materialise(narrow, "keys")
    gone = copy_ids(narrow, "_key", id_col)
    survivors = (
        narrow.where("_long").select(id_col, label_col).join(gone, id_col, "left_anti")
    )
    return stratified_split(
        materialise(survivors, "survivors"), label_col, id_col, seed
    )


def attach_split(df: DataFrame, split: DataFrame, id_col: str) -> DataFrame:
    """Full rows with their split, ready for ``writers.write_splits``.

    Rows without an id cannot be told apart and are left out here.
    """
    return df.join(split.select(id_col, "split"), id_col)


def explain_comments(
    comments: DataFrame,
    ids: Sequence[str],
    text_col: str,
    scorer,
    threshold: float = fixed.THRESHOLD,
    labels: Sequence[str] = fixed.LABELS,
) -> DataFrame:
    """Highlights of the toxic comments through the general occlusion path."""
    scored = predict(
        comments,
        text_col,
        scorer,
        threshold,
        highlight_tokens=False,
        keep=ids,
        labels=labels,
    ).where("is_toxic")
    ready = scored.select(
        *ids, "overall_score", decode_leet(F.col("cleaned_text")).alias("model_text")
    )
    return explain_by_occlusion(ready, ids, scorer)


def explained_records(
    comments: DataFrame,
    ids: Sequence[str],
    text_col: str,
    scorer,
    threshold: float = fixed.THRESHOLD,
    labels: Sequence[str] = fixed.LABELS,
) -> DataFrame:
    """Records with highlights for any scorer; ``ids`` must be unique.

    The records are written once; only toxic ones meet their highlights, so other texts
    are not moved.
    """
    records = predict(
        comments, text_col, scorer, threshold, highlight_tokens=False, keep=ids, labels=labels
    )
    records = materialise(records, "records")
    toxic = records.where("is_toxic")
    ready = toxic.select(
        *ids, "overall_score", decode_leet(F.col("cleaned_text")).alias("model_text")
    )
    if isinstance(scorer, linear_heads.LinearHeads):
        found = linear_heads.explain(ready, ids, scorer)
    else:
        found = explain_by_occlusion(ready, ids, scorer)
    explained = toxic.drop("token_highlights").join(found, list(ids))
    return records.where("not is_toxic").unionByName(explained)


def fit_moderation_heads(
    documents: DataFrame, labels: DataFrame, text_col: str, id_col: str, names: Sequence[str]
) -> linear_heads.LinearHeads:
    """Log-odds heads of 0/1 label columns over the normalised texts."""
    texts = labels.select(id_col, *names).join(
        documents.select(id_col, model_text(F.col(text_col)).alias("text")), id_col
    )
    return linear_heads.fit_log_odds(materialise(texts, "labelled"), "text", names)


def moderate(
    comments: DataFrame, text_col: str, keep: Sequence[str] = (), **scoring
) -> DataFrame:
    """Batch moderation: prediction records of the non-blank comments."""
    return predict_batch(
        comments.where(~is_blank(F.col(text_col))), text_col, keep=keep, **scoring
    )


@dataclass
class Evaluation:
    """A fitted model with its test predictions and metrics."""

    model: PipelineModel
    classes: list[str]
    predictions: DataFrame
    matrix: DataFrame
    summary: DataFrame
    report: DataFrame


def evaluate_model(model: PipelineModel, test: DataFrame, label_col: str) -> Evaluation:
    """Metrics of a fitted or loaded model on labelled rows, without training."""
    classes = models.class_labels(model)
    predictions = models.predict_classes(model, test, label_col)
    matrix = metrics.confusion_matrix(predictions, classes)
    return Evaluation(
        model,
        classes,
        predictions,
        matrix,
        metrics.summary_metrics(matrix),
        metrics.class_report(matrix),
    )


def labelled_model_texts(
    df: DataFrame, split: DataFrame, text_col: str, label_col: str, id_col: str
) -> DataFrame:
    """``(id, label, split, text)`` with normalised text, written down once.

    Every fit and evaluation reads it, partitioned by split.
    """
    texts = df.select(id_col, model_text(F.col(text_col)).alias("text")).join(
        split.select(id_col, label_col, "split"), id_col
    )
    return materialise(texts, "model-texts")


def train_linear(texts: DataFrame, label_col: str, **linear) -> Evaluation:
    """Fit TF-IDF and the linear model on train, evaluate on test."""
    part = {s: texts.where(F.col("split") == s).drop("split") for s in ("train", "test")}
    model = models.fit_baseline(part["train"], label_col, "text", **linear)
    return evaluate_model(model, part["test"], label_col)


def train_pooled_embedding(
    texts: DataFrame, label_col: str, id_col: str, **network
) -> Evaluation:
    """Fit vocabulary, embedding and network on train, evaluate on test."""
    train = texts.where(F.col("split") == "train")
    vocabulary = materialise(
        models.training_vocabulary(train, "text", id_col), "vocabulary"
    )
    tokens = models.tokens_with_unknown(texts, id_col, "text", vocabulary)
    ready = materialise(
        texts.select(id_col, label_col, "split").join(tokens, id_col), "tokens"
    )
    model = models.fit_pooled_embedding(
        ready.where(F.col("split") == "train").drop("split"), label_col, **network
    )
    test = ready.where(F.col("split") == "test").drop("split")
    return evaluate_model(model, test, label_col)
