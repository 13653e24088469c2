"""Pluggable scorers, and the classifier trained on a prepared corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden.functions import scores as sc
from modwarden.functions import windows as wn
from modwarden.functions.automaton import cuts, text_bytes, utf8
from modwarden.functions.hashed import murmur3
from modwarden.operators.ranking import SALTS
from modwarden.profiles import ScorePolicy, WindowPolicy
from modwarden.session import materialize

WHOLE = WindowPolicy(max_windows=None)

Scorer = Callable[[pd.Series], pd.Series]


def scorer_column(load: Callable[[], Scorer], c: Column | str) -> Column:
    """Any text model as a column: ``load`` runs once per Python worker, then scores Arrow batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield model(texts).astype("float64")

    return score(F.col(c) if isinstance(c, str) else c)


def score_distinct(df: DataFrame, text: str, score: Callable[[str], Column], out: str = "score") -> DataFrame:
    """Scores each distinct text about once and joins the score back; worth it where texts repeat.

    Copies of a text are spread over salts, each of which scores it once, so a hot text is shared out.
    """
    keyed = df.withColumn("_digest", F.md5(text)).withColumn("_salt", F.floor(F.rand() * SALTS))
    keyed = materialize(keyed, "scoring")
    one = keyed.groupBy("_digest", "_salt").agg(F.first(text).alias(text))
    scored = one.select("_digest", "_salt", score(text).alias(out))
    both = (F.col("k._digest").eqNullSafe(F.col("s._digest"))) & (F.col("k._salt") == F.col("s._salt"))
    return keyed.alias("k").join(scored.alias("s"), both, "left").select(*[F.col(f"k.{c}") for c in df.columns], f"s.{out}")


def array_scorer(load: Callable[[], Scorer]) -> Callable[[Column], Column]:
    """A text model over arrays of texts: all windows of an Arrow batch are scored in one call."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            sizes = texts.map(len)
            flat = texts.explode().dropna()
            scores = iter(model(flat).astype("float64")) if len(flat) else iter(())
            yield pd.Series([[next(scores) for _ in range(n)] for n in sizes], index=texts.index, dtype=object)

    return run


def score_windows(
    df: DataFrame, key: str, text: str, score: Callable[[Column], Column],
    windows: WindowPolicy = WHOLE, policy: ScorePolicy = ScorePolicy(),
) -> DataFrame:
    """The window of each text that decides; ``score`` turns an array of texts into an array of scores.

    Windows are an array of the row and ranked by higher-order functions, so a document never leaves its row.
    Every row stays; a blank text is clean with score 0 and no window.
    """
    cut = df.select(key, F.coalesce(wn.window_text(text, windows), F.array().cast(wn.WINDOW_TYPE)).alias("w"))
    return decide_windows(cut.withColumn("s", score(F.transform("w", lambda x: x["text"]))), key, policy, windows.evidence_chars)


def decide_windows(df: DataFrame, key: str, policy: ScorePolicy = ScorePolicy(), evidence_chars: int = 240) -> DataFrame:
    """The deciding window of rows with windows ``w`` and their scores ``s``: the first at the block cut-off, else the top one."""
    rows = F.zip_with("w", "s", lambda w, s: F.struct(w["ix"].alias("ix"), F.coalesce(s, F.lit(0.0)).alias("score"), F.substring(w["text"], 1, evidence_chars).alias("window")))
    ranked = df.select(key, rows.alias("r")).withColumn("b", F.filter("r", lambda x: x["score"] >= policy.block))
    top = F.array_max(F.transform("r", lambda x: F.struct(x["score"].alias("score"), (-x["ix"]).alias("at"), x["window"].alias("window"))))
    picked = ranked.select(key, F.size("r").alias("n"), F.try_element_at("b", F.lit(1)).alias("first"), top.alias("top"))
    score = F.coalesce("first.score", "top.score", F.lit(0.0))
    return picked.select(
        key,
        score.alias("score"),
        F.coalesce("first.ix", -F.col("top.at")).alias("window_ix"),
        F.coalesce("first.window", "top.window").alias("window"),
        F.when(F.col("first").isNotNull(), F.col("first.ix") + 1).otherwise(F.col("n")).alias("windows"),
        sc.text_action(score, policy).alias("action"),
        sc.text_tier(score, policy).alias("tier"),
    )


def score_images(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Any image model: ``load`` once per worker, then one frame of label scores per Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield model(pdf)

    return images.mapInPandas(run, schema)


def build_pipeline(reg: float, features: int = 1 << 16, text: str = "text", label: str = "label") -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}]+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, regParam=reg, maxIter=20),
    ])


def predict(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("_tokens", "_tf", "_features", "rawPrediction", "probability", "prediction")


def train_classifier(
    train: DataFrame, val: DataFrame, regs: Sequence[float] = (0.01, 0.1), text: str = "text", label: str = "label"
) -> tuple[PipelineModel, DataFrame]:
    """Best model of a small grid by validation F1, and one metrics row per run."""
    from modwarden.operators.evaluate import confusion_metrics

    runs, best, best_f1 = None, None, -1.0
    for reg in regs:
        model = build_pipeline(reg, text=text, label=label).fit(train)
        row = confusion_metrics(predict(model, val), "score", label, 0.5, 0.9).withColumn("reg", F.lit(reg))
        c = row.first()
        f1 = 2 * c["tp"] / max(1, 2 * c["tp"] + c["fp"] + c["fn"])
        if f1 > best_f1:
            best, best_f1 = model, f1
        runs = row if runs is None else runs.unionByName(row)
    return best, runs


@dataclass(frozen=True)
class FoldedModel:
    """A trained text pipeline as one weight per feature: the inverse document frequencies are multiplied in."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text of words that single spaces part."""
        data, offsets = utf8(texts)
        word = data != 32
        before, after = np.append(True, ~word[:-1]), np.append(~word[1:], True)
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner], after[inner - 1] = True, True
        starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        # Summed text by text, so that a score does not depend on the texts beside it.
        n = np.diff(np.searchsorted(starts, offsets))
        sums = np.bincount(np.repeat(np.arange(len(n)), n), self.weights[murmur3(data, starts, ends) % len(self.weights)], len(n))
        return 1 / (1 + np.exp(-(sums + self.intercept)))


def fold(model: PipelineModel) -> FoldedModel:
    """The weights of a model of :func:`build_pipeline`."""
    _, tf, idf, linear = model.stages
    if tf.getNumFeatures() != len(idf.idf):
        raise ValueError("the stages of this model do not belong together")
    return FoldedModel(linear.coefficients.toArray() * idf.idf.toArray(), float(linear.intercept))


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where each list begins among the values of all, and where the last one ends."""
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int64)


def folded_scorer(spark: SparkSession, model: FoldedModel) -> Callable[[Column], Column]:
    """Scores of an array of texts by a folded model; words are cut in the JVM, as the pipeline's tokenizer cuts them."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            # A bounded number of bytes at a time.
            first = _bounds(lists)
            for a, b in cuts(np.diff(np.append(0, np.cumsum(text_bytes(lists.flatten())))[first])):
                some = lists.slice(a, b - a)
                yield pa.ListArray.from_arrays(pa.array(_bounds(some), pa.int32()), pa.array(shared.value.scores(some.flatten())))

    return lambda texts: score(F.transform(texts, lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}]+", " ")))


def score_documents(
    model: PipelineModel, df: DataFrame, key: str, text: str, policy: ScorePolicy = ScorePolicy(), windows: WindowPolicy = WHOLE
) -> DataFrame:
    """A trained model over windows of each document; the whole text unless a window policy says otherwise.

    The model is folded into one vector and scores the array of windows inside the row, so nothing is shuffled. A document
    without a window stays as clean, with score 0.
    """
    return score_windows(df, key, text, folded_scorer(df.sparkSession, fold(model)), windows, policy)


def image_decisions(df: DataFrame, nsfw_scores: str, violence_scores: str) -> DataFrame:
    """Both image policies and the stronger one, as columns of one stage."""
    v = F.col(violence_scores)
    return df.withColumn("nsfw_action", sc.nsfw_action(nsfw_scores)).withColumn(
        "violence_action",
        sc.violence_action(*[F.try_element_at(v, F.lit(n)) for n in ("violence", "sensitive", "weapon")]),
    ).withColumn("image", sc.strongest_image("nsfw_action", "violence_action"))
