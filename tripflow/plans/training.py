"""Training: labelled station table, stratified split, boosted trees, quality, artifacts."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.operators.impute import fit_fill_values
from tripflow.operators.metrics import classification_report, pr_auc, roc_auc
from tripflow.operators.ranking import exact_quantiles
from tripflow.operators.split import stratified_split
from tripflow.operators.stations import feature_contract
from tripflow.schemas import CATEGORICAL_FEATURES, LABEL, NUMERIC_FEATURES
from tripflow.session import cut_lineage
from tripflow.sources.logs import read_record, write_record
from tripflow.sources.station_files import volume_years

# Label quantile, test share, seed and the boosting defaults.
LABEL_QUANTILE = 0.75
TEST_SIZE = 0.2
SEED = 42
TREES = 100
DEPTH = 3
LEARNING_RATE = 0.1

IDENTITY = ["STATION_ID", "FUNCTIONAL_CLASS", "KFACTOR", "DFACTOR", "STATION_TYPE"]


def label_threshold(stations: DataFrame) -> DataFrame:
    """One row: the exact 75th percentile of the latest volume, nulls ignored."""
    return exact_quantiles(stations, ["AADT_LATEST"], LABEL_QUANTILE).select(F.col("quantile").alias("threshold"))


def labelled(stations: DataFrame) -> DataFrame:
    """Adds the label; stations without a latest volume get 0 and stay."""
    high = F.col("AADT_LATEST") >= label_threshold(stations).scalar()
    return stations.withColumn(LABEL, F.coalesce(high, F.lit(False)).cast("int"))


def training_table(stations: DataFrame) -> DataFrame:
    """Features, label and ``is_test``.

    Threshold and split read the table several times, so the merge behind it is
    written out once.
    """
    rows = cut_lineage(labelled(cut_lineage(stations)))
    split = stratified_split(rows, LABEL, [c for c in IDENTITY if c in rows.columns], TEST_SIZE, SEED)
    return feature_contract(split, keep=[LABEL, "is_test"])


def _fill_statement(values: dict) -> str:
    """Fitted fill values as a savable pipeline stage."""

    def filled(name: str, kind: str) -> str:
        value = values.get(name)
        if value is None:
            literal = f"CAST(NULL AS {kind})"
        elif kind == "DOUBLE":
            literal = f"CAST('{value!r}' AS DOUBLE)"
        else:
            literal = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"coalesce(`{name}`, {literal}) AS `{name}_FILLED`"

    columns = [filled(c, "DOUBLE") for c in NUMERIC_FEATURES] + [filled(c, "STRING") for c in CATEGORICAL_FEATURES]
    return f"SELECT *, {', '.join(columns)} FROM __THIS__"


def feature_stages(train: DataFrame) -> list:
    """Imputation, one-hot encoding and assembly into ``features``.

    A category unseen in training falls into the indexer's extra slot, which the
    encoder drops, so it becomes all zeros.
    """
    values = fit_fill_values(train, NUMERIC_FEATURES, CATEGORICAL_FEATURES)
    numeric = [c for c in NUMERIC_FEATURES if values.get(c) is not None]
    categorical = [c for c in CATEGORICAL_FEATURES if values.get(c) is not None]
    stages = [
        SQLTransformer(statement=_fill_statement(values)),
        StringIndexer(
            inputCols=[f"{c}_FILLED" for c in categorical],
            outputCols=[f"{c}_INDEX" for c in categorical],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_INDEX" for c in categorical],
            outputCols=[f"{c}_VECTOR" for c in categorical],
            dropLast=True,
        ),
    ]
    if not categorical:
        stages = stages[:1]
    inputs = [f"{c}_FILLED" for c in numeric] + [f"{c}_VECTOR" for c in categorical]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def fit_model(train: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """Features and gradient-boosted trees as one savable pipeline."""
    boosted = GBTClassifier(
        labelCol=LABEL, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=LEARNING_RATE, seed=SEED
    )
    return Pipeline(stages=[*feature_stages(train), boosted]).fit(train)


def with_probability(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds the positive-class ``probability`` to contract-shaped rows."""
    keep = rows.columns
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability")[1])
    return scored.select(*keep, F.col("_p").alias("probability"))


def score_stations(stations: DataFrame, model: PipelineModel) -> DataFrame:
    """(station_id, lat, lon, probability): every station once, reused by every trip."""
    shaped = feature_contract(stations, keep=["STATION_ID"])
    return with_probability(shaped, model).select(
        F.col("STATION_ID").alias("station_id"), F.col("LAT").alias("lat"), F.col("LON").alias("lon"), "probability"
    )


def train(stations: DataFrame, trees: int = TREES, depth: int = DEPTH) -> tuple[PipelineModel, DataFrame]:
    """Fitted model, and the scored test rows (label, probability)."""
    table = cut_lineage(training_table(stations))
    model = fit_model(table.where(~F.col("is_test")).drop("is_test"), trees, depth)
    scored = with_probability(table.where("is_test").drop("is_test"), model)
    return model, scored.select(LABEL, "probability")


def quality(scored: DataFrame) -> dict:
    """ROC and PR area and the classification report, all as plain numbers."""
    areas = {
        "ROC_AUC": roc_auc(scored, LABEL, "probability").first()["roc_auc"],
        "PR_AUC": pr_auc(scored, LABEL, "probability").first()["pr_auc"],
    }
    # a row per class and three averages
    report = classification_report(scored, LABEL, "probability").collect()
    measures = ["precision", "recall", "f1", "support"]
    return areas | {f"{r['row']} {m}": None if r[m] is None else float(r[m]) for r in report for m in measures}


def contract_record(stations: DataFrame) -> dict:
    """The model's input contract; its keys are fixed values."""
    latest = volume_years(stations.columns)[-1]
    return {
        "numeric_features": NUMERIC_FEATURES,
        "categorical_features": CATEGORICAL_FEATURES,
        "label": LABEL,
        "label_definition": f"1 if AADT_{latest} >= 75th percentile; else 0",
        "latest_year": latest,
    }


def save_artifacts(spark: SparkSession, folder: str, model: PipelineModel, contract: dict, metrics: dict) -> None:
    model.write().overwrite().save(f"{folder}/model")
    write_record(spark, contract, f"{folder}/feature_schema")
    write_record(spark, metrics, f"{folder}/metrics")


def load_artifacts(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{folder}/model"), read_record(spark, f"{folder}/feature_schema")
