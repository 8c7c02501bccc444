"""Imputing, scaling and encoding features; ridge and boosted trees; key checks."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_columns(columns: list[str], allowed: set[str], forbidden: set[str]) -> None:
    """Raise if a feature table has a column that is forbidden or unknown."""
    bad = [c for c in columns if c in forbidden or c not in allowed]
    if bad:
        raise ValueError(f"columns that must not be features: {', '.join(sorted(bad))}")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that raises if either side repeats a key."""
    for side in (left, right):
        if side.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
            raise ValueError(f"{key} is repeated")
    return left.join(right, key)


def features(numeric: list[str], categorical: list[str]) -> list:
    """Stages: median imputing and scaling of numbers, one-hot coding of categories; unknown ones keep a place."""
    medians = Imputer(inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric], strategy="median")
    numbers = VectorAssembler(inputCols=[f"{c}_filled" for c in numeric], outputCol="numbers")
    scaled = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True)
    index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep")
    return [medians, numbers, scaled, index, hot, VectorAssembler(inputCols=["scaled", *[f"{c}_hot" for c in categorical]], outputCol="features")]


def fit_ridge(train: DataFrame, numeric: list[str], categorical: list[str], label: str, penalty: float) -> PipelineModel:
    """Ridge regression with an absolute penalty, as sums of squares count it."""
    n = train.count()
    model = LinearRegression(featuresCol="features", labelCol=label, elasticNetParam=0.0, regParam=penalty / max(1, n), standardization=False)
    return Pipeline(stages=[*features(numeric, categorical), model]).fit(train)


def fit_trees(train: DataFrame, numeric: list[str], categorical: list[str], label: str, depth: int = 4, rounds: int = 20) -> PipelineModel:
    """Gradient-boosted trees."""
    model = GBTRegressor(featuresCol="features", labelCol=label, maxDepth=depth, maxIter=rounds, seed=7)
    return Pipeline(stages=[*features(numeric, categorical), model]).fit(train)


def mean_error(fitted: PipelineModel, rows: DataFrame, label: str) -> float:
    """Mean absolute error of a model over the rows that have a label."""
    return fitted.transform(rows.where(F.col(label).isNotNull())).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]


def grid_search(train: DataFrame, dev: DataFrame, fit, settings: list, label: str) -> tuple[PipelineModel, DataFrame]:
    """The model refitted on train and dev together under the setting with the least error on dev, and (setting, mae, is_best).

    ``fit`` makes a model of rows and a setting. Of equal errors the first setting wins.
    """
    errors = [mean_error(fit(train, s), dev, label) for s in settings]
    best = min(range(len(settings)), key=lambda k: (errors[k], k))
    table = train.sparkSession.createDataFrame([(str(s), float(e), k == best) for k, (s, e) in enumerate(zip(settings, errors))], "setting string, mae double, is_best boolean")
    return fit(train.unionByName(dev), settings[best]), table


def cross_validated(rows: DataFrame, fold: str, folds: int, fit, label: str) -> DataFrame:
    """(fold, n, mae): each fold scored by a model of the others."""
    out = []
    for k in range(folds):
        test = rows.where(F.col(fold) == k)
        n = test.where(F.col(label).isNotNull()).count()
        out.append((k, n, mean_error(fit(rows.where(F.col(fold) != k)), test, label) if n else None))
    return rows.sparkSession.createDataFrame(out, "fold bigint, n bigint, mae double")
