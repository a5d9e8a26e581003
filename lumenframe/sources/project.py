"""Projects: one Parquet folder for each stage and a JSON row of settings; nothing is pickled."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lumenframe.operators import boosting, guessing
from lumenframe.operators.boosting import Booster, Tree
from lumenframe.operators.learning import Discriminant, apply_discriminant
from lumenframe.operators.svc import Svc
from lumenframe.plans.pipeline import Step, apply

#: Stages that a production project leaves out.
RAW = frozenset({"input", "converted", "cut", "baseline", "smoothed", "normalized", "trimmed"})


def save(spark: SparkSession, path: str, stages: dict[str, DataFrame], settings: dict, production: bool = False) -> None:
    kept = {k: v for k, v in stages.items() if not (production and k in RAW)}
    for name, df in kept.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    row = json.dumps({"settings": settings, "stages": sorted(kept), "production": production})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    told = json.loads(spark.read.text(f"{path}/settings").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in told["stages"]}, told["settings"]


def export(path: str, tables: dict[str, DataFrame]) -> list[str]:
    """One CSV folder with a header for each table that has rows (in place of a workbook's sheets); returns their names.

    Arrays, maps and structs are written as JSON.
    """
    told = []
    for name, df in tables.items():
        if df.isEmpty():
            continue
        flat = df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(c) for c in df.columns))
        flat.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
        told.append(name)
    return told


def _told(model) -> dict:
    """A model of this library as JSON; its size is that of its parameters."""
    if isinstance(model, Booster):
        return {"settings": asdict(model.settings), "n_classes": model.n_classes, "cuts": [c.tolist() for c in model.cuts], "trees": [[asdict(t) for t in r] for r in model.trees]}
    return {"n_classes": model.n_classes} | {c: getattr(model, c).tolist() for c in ("pairs", "w", "bias", "slope", "offset")}


def _made(kind: str, told: dict):
    if kind == "boosted":
        trees = [[Tree(**t) for t in r] for r in told["trees"]]
        return Booster(boosting.Settings(**told["settings"]), told["n_classes"], [np.array(c, float) for c in told["cuts"]], trees)
    return Svc(told["n_classes"], *(np.array(told[c]) for c in ("pairs", "w", "bias", "slope", "offset")))


def _write_text(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_model(spark: SparkSession, path: str, name: str, model, steps: list[Step] = ()) -> None:
    """A fitted model and the steps that its spectra went through, for production: one folder a model."""
    kind = "linear" if isinstance(model, Discriminant) else "boosted" if isinstance(model, Booster) else "pairs" if isinstance(model, Svc) else "spark"
    if kind == "linear":
        rows = [(float(c), [float(v) for v in w], float(b)) for c, w, b in zip(model.classes, model.w, model.b, strict=True)]
        spark.createDataFrame(rows, "class double, w array<double>, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/models/{name}/classes")
    elif kind == "spark":
        PipelineModel([model]).write().overwrite().save(f"{path}/models/{name}/fitted")
    else:
        _write_text(spark, f"{path}/models/{name}/parameters", _told(model))
    _write_text(spark, f"{path}/models/{name}/settings", {"kind": kind, "steps": [{"kind": s.kind, "name": s.name, "params": s.params} for s in steps]})


def load_model(spark: SparkSession, path: str, name: str) -> tuple[object, list[Step]]:
    """The model (its stage, the discriminant, the booster or the machines) and the steps before it."""
    told = json.loads(spark.read.text(f"{path}/models/{name}/settings").first()[0])
    steps, kind = [Step(**s) for s in told["steps"]], told["kind"]
    if kind == "spark":
        return PipelineModel.load(f"{path}/models/{name}/fitted").stages[0], steps
    if kind != "linear":
        return _made(kind, json.loads(spark.read.text(f"{path}/models/{name}/parameters").first()[0])), steps
    rows = spark.read.parquet(f"{path}/models/{name}/classes").orderBy("class").collect()  # a row a class
    return Discriminant(*(np.array([r[c] for r in rows]) for c in ("class", "w", "b"))), steps


@dataclass(frozen=True)
class Production:
    """What new spectra go through: frozen steps (axis and EMSC reference are among their settings), the template's lines if features are decomposed, the models."""

    steps: list[Step]
    models: dict[str, object]
    lines: DataFrame | None = None
    shape: str = "Gaussian"
    fwhm: float = 40.0

    def features(self, spectra: DataFrame) -> DataFrame:
        """key, label (the group), features: the steps' values, or the heights of the template's lines in their order (0 where a line wasn't fitted)."""
        ready = apply(spectra, self.steps)
        if self.lines is None:
            return ready.select("key", F.col("grp").cast("double").alias("label"), array_to_vector("y").alias("features"))
        numbers = [r["line"] for r in guessing.bounded(self.lines).select("line").orderBy("line").collect()]
        fitted = guessing.fit_template(ready, self.lines, self.shape, self.fwhm)
        heights = fitted.groupBy("key", "grp").agg(F.map_from_entries(F.collect_list(F.struct("line", "a"))).alias("a"))
        height = F.array(*(F.coalesce(F.try_element_at("a", F.lit(n)), F.lit(0.0)) for n in numbers))
        return heights.select("key", F.col("grp").cast("double").alias("label"), array_to_vector(height).alias("features"))

    def predict(self, spectra: DataFrame) -> DataFrame:
        """key, model, prediction, probability: a row for each spectrum and model."""
        ready, out = self.features(spectra), []
        for name, model in sorted(self.models.items()):
            if isinstance(model, Discriminant):
                said = apply_discriminant(ready, model)
            else:
                said = model.transform(ready)
                said = said.withColumn("probability", vector_to_array("probability"))
            out.append(said.select("key", F.lit(name).alias("model"), "prediction", "probability"))
        return reduce(DataFrame.unionByName, out)


def save_production(spark: SparkSession, path: str, production: Production) -> None:
    for name, model in production.models.items():
        save_model(spark, path, name, model, production.steps)
    if production.lines is not None:
        production.lines.coalesce(1).write.mode("overwrite").parquet(f"{path}/template")
    _write_text(spark, f"{path}/production", {"models": sorted(production.models), "template": production.lines is not None, "shape": production.shape, "fwhm": production.fwhm, "steps": [asdict(s) for s in production.steps]})


def load_production(spark: SparkSession, path: str) -> Production:
    told = json.loads(spark.read.text(f"{path}/production").first()[0])
    lines = spark.read.parquet(f"{path}/template") if told["template"] else None
    return Production([Step(**s) for s in told["steps"]], {n: load_model(spark, path, n)[0] for n in told["models"]}, lines, told["shape"], told["fwhm"])
