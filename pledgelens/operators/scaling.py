"""Z-scores with parameters that are fitted once and can be frozen."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A deviation below this counts as constant: the scaled value is 0.
MIN_STD = 1e-10


def fit_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, mean, std, count)`` over non-null values, population deviation."""
    wide = df.agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count(c).alias("count")).alias(c)
        for c in columns])
    return wide.unpivot([], columns, "feature", "s").select("feature", "s.mean", "s.std", "s.count")


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled by their own mean and population deviation; null stays null."""
    return Scaler(fit_on_train=False).fit(df, columns).transform(df)


@dataclass
class Scaler:
    """Fit on the training rows, apply anywhere; parameters are one row per column."""

    fit_on_train: bool = True
    params: dict[str, dict] = field(default_factory=dict)
    fitted: bool = False

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> "Scaler":
        if columns is None:
            columns = [c for c in df.columns if "readability" in c]
        columns = [c for c in columns if c in df.columns]
        rows = fit_parameters(df, columns).collect() if columns else []
        self.params = {r["feature"]: {"mean": r["mean"], "std": r["std"], "count": r["count"]} for r in rows}
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise ValueError("fit the scaler first")
        scaled = {}
        for c, p in self.params.items():
            if c not in df.columns or p["mean"] is None:
                continue
            if p["std"] < MIN_STD:
                scaled[c] = F.lit(0.0)
            else:
                scaled[c] = (F.col(c) - F.lit(p["mean"])) / F.lit(p["std"])
        return df.withColumns(scaled) if scaled else df

    def fit_transform(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def summary(self, spark: SparkSession) -> DataFrame:
        rows = [(c, p["mean"], p["std"], p["count"]) for c, p in self.params.items()]
        return spark.createDataFrame(rows, "feature string, mean double, std double, count bigint")

    def to_json(self) -> str:
        return json.dumps({"fit_on_train": self.fit_on_train, "fitted": self.fitted, "params": self.params})

    @classmethod
    def from_json(cls, text: str) -> "Scaler":
        data = json.loads(text)
        return cls(data.get("fit_on_train", True), data.get("params", {}), data.get("fitted", False))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the parameters as a one-row JSON text table."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scaler":
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])


def scale_on_train(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, Scaler]:
    """Fit on the training rows, apply to both sides."""
    scaler = Scaler().fit(train, columns)
    return scaler.transform(train), scaler.transform(test), scaler
