"""Classifiers as pyspark.ml pipelines, from word and character n-grams, and their comparison over seeds and variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import metrics


def ngram_features(df: DataFrame, tokens: str, out: str = "terms") -> DataFrame:
    """df with its terms: word 1- and 2-grams, and character 3- to 5-grams inside words."""
    chars = F.flatten(F.transform(F.col(tokens), lambda t: X.char_ngrams(t, 3, 5)))
    return df.withColumn(out, F.concat(F.col(tokens), X.word_ngrams(F.col(tokens), 2), chars))


def representation(kind: str, least: int = 2, size: int = 1 << 18) -> list:
    """Stages from `terms` to `features`: bow counts, or tfidf of unit length."""
    count = CountVectorizer(inputCol="terms", outputCol="features" if kind == "bow" else "counts", minDF=least, vocabSize=size)
    return [count] if kind == "bow" else [count, IDF(inputCol="counts", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features")]


LEARNERS: dict[str, Callable[[], object]] = {
    "nb": lambda: NaiveBayes(smoothing=1.0),
    "logreg": lambda: LogisticRegression(regParam=1e-3, maxIter=100, standardization=False),
    "svm": lambda: LinearSVC(regParam=1e-3, maxIter=100),
    "xgb": lambda: GBTClassifier(maxIter=50, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=42),
}
MODELS = {f"{r}_{m}": (r, m) for r in ("bow", "tfidf") for m in ("nb", "logreg", "svm")}


def text_model(name: str) -> Pipeline:
    kind, learner = MODELS[name]
    return Pipeline(stages=[*representation(kind), LEARNERS[learner]()])


def numeric_model(features: list[str], learner: str = "logreg") -> Pipeline:
    """Over standardised numeric columns."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LEARNERS[learner]()])


def vector_model(learner: str = "logreg") -> Pipeline:
    """Over document vectors from Word2Vec of `tokens`."""
    return Pipeline(stages=[Word2Vec(inputCol="tokens", outputCol="features", vectorSize=64, minCount=2, seed=42), LEARNERS[learner]()])


def confidence(df: DataFrame) -> Column:
    """The probability of class 1, or the margin where a model has none."""
    return vector_to_array(F.col("probability" if "probability" in df.columns else "rawPrediction"))[1]


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("confidence", confidence(out)).withColumn("pred", F.col("prediction").cast("int"))


def compare(train: DataFrame, dev: DataFrame, models: dict[str, Pipeline], label: str = "label") -> DataFrame:
    """(model, scores) of each model fitted on train and scored on dev."""
    out = None
    for name, p in models.items():
        row = metrics.evaluate(predicted(p.fit(train), dev), label, "pred").withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def ablation(train: DataFrame, dev: DataFrame, text: str, variants: dict[str, dict], model: str = "tfidf_logreg", label: str = "label") -> DataFrame:
    """A model under each preprocessing variant."""
    out = None
    for name, how in variants.items():
        prepared = [ngram_features(d.withColumn("tokens", X.preprocess(F.col(text), name, **how)), "tokens") for d in (train, dev)]
        row = compare(prepared[0], prepared[1], {model: text_model(model)}, label).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def ensemble(models: dict[str, PipelineModel], df: DataFrame, key: str) -> DataFrame:
    """(key, votes, correct): how many models predict 1, and the majority."""
    votes = None
    for m in models.values():
        one = predicted(m, df).select(key, "pred")
        votes = one if votes is None else votes.unionByName(one)
    return votes.groupBy(key).agg(F.sum("pred").alias("votes"), (F.avg("pred") > 0.5).cast("int").alias("correct"))


def probe(df: DataFrame, features: list[str], label: str, group: str, seed: int = 42) -> DataFrame:
    """Can surface features alone tell the label? Scores on a fifth of the groups that training doesn't see."""
    from textmill.operators.sampling import hash_split

    held = hash_split(group, 0.2, seed)
    return compare(df.where(~held), df.where(held), {"probe": numeric_model(features)}, label)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def top_coefficients(model: PipelineModel, names: list[str], k: int = 3) -> list[tuple[str, float]]:
    """The k names with the largest weights by size of a linear model over these columns. The model is on the driver as it is."""
    weights = model.stages[-1].coefficients.toArray()
    order = sorted(range(len(names)), key=lambda i: (-abs(weights[i]), names[i]))
    return [(names[i], float(weights[i])) for i in order[:k]]


def confidence_scale(name: str) -> str:
    """What a model's confidence is: a probability, or a margin where it gives none."""
    return "margin" if MODELS.get(name, ("", name))[1] == "svm" else "probability"


def missing(built: list[str], wanted: list[str]) -> list[str]:
    """The wanted models that aren't built yet."""
    return sorted(set(wanted) - set(built))
