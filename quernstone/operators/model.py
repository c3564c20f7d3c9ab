"""A linear text model trained here: features, fit, scores, attributions, metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import detect, evaluation


def fit(train: DataFrame, features: int = 1 << 16, regularization: float = 0.01, iterations: int = 20) -> PipelineModel:
    """Logistic regression over hashed words of all rows of ``train`` (text, label); rows with a
    null text or label are left out."""
    rows = train.where("text is not null and label is not null").select("text", F.col("label").cast("double").alias("label"))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\W+"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=features),
        LogisticRegression(maxIter=iterations, regParam=regularization),
    ]
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of label 1; null texts score as empty ones."""
    out = model.transform(df.withColumn("_t", F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))))
    return out.withColumn("score", F.round(F.get(vector_to_array("probability"), 1), 9)).withColumn("text", F.col("_t")).drop("_t", "words", "features", "rawPrediction", "probability", "prediction")


def explain(model: PipelineModel, df: DataFrame, key: str = "id", top_k: int = 10) -> DataFrame:
    """(key, attribution): the words with the greatest |coefficient|, scaled to 0..1, of texts cut to
    4,096 characters.  For a linear model integrated gradients are exactly coefficient times
    value.  A word's coefficient is the margin of the text that is this word alone, so it is
    computed by the model itself, inside the JVM.  Blank and null texts have none.
    """
    tokenizer, hashing, lr = model.stages
    words = tokenizer.transform(df.select(key, F.left("text", F.lit(4096)).alias("text")).where("text is not null"))
    each = words.select(key, F.posexplode("words").alias("pos", "word")).withColumn("words", F.array("word"))
    margin = F.get(vector_to_array("rawPrediction"), 1) - F.lit(float(lr.intercept))
    scored = lr.transform(hashing.transform(each)).select(key, "pos", "word", F.abs(margin).alias("s"))
    ordered = scored.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "word", "s"))).alias("w"))
    tokens, scores = F.transform("w", lambda w: w.word), F.transform("w", lambda w: w.s)
    return ordered.select(key, detect.token_attribution(tokens, scores, top_k).alias("attribution"))


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: confusion, ratios and average precision."""
    c = evaluation.confusion(scored.withColumn("pred", F.when(F.col("score") >= threshold, 1).otherwise(0)))
    ap = evaluation.average_precision(scored.withColumn("_o", F.xxhash64("text")), "score", "label", "_o")
    return c.withColumn("_j", F.lit(1)).join(F.broadcast(ap.select("pr_auc", F.lit(1).alias("_j"))), "_j").drop("_j")  # one row each
