"""Scans with column contracts, record scans from JSON, and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself; an error that names what is missing, before any job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_raw_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A raw table as strings by an explicit schema taken from the header, with its required columns."""
    header = spark.read.option("header", True).csv(path).columns
    return required(spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).option("header", True).csv(path), columns)


def optional(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that exist, in the wanted order; the scan reads no others."""
    return df.select(*[c for c in wanted if c in df.columns])


def predictions(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """actual and predicted as int, and the attributes that exist."""
    required(df, ["actual", "predicted"])
    keep = [c for c in ("record_id", "score") if c in df.columns]
    return df.select(*keep, F.col("actual").cast("int").alias("actual"), F.col("predicted").cast("int").alias("predicted"), *[a for a in attrs if a in df.columns])


SCORES = "struct<completeness:double,severity_agreement:double,cause_alignment:double,mitigation_specificity:double,research_grounding:double>"
RECORD = (
    "dataset string, attribute string, cycle int, model string, "
    "result struct<attribute:string,severity:string,what_is_wrong:string,why_is_wrong:string,how_to_fix:string,supporting_research:array<string>>, "
    f"score struct<total_score:double,subscores:{SCORES}>, refusal_detected boolean, hallucination_flags array<string>, "
    "usage struct<wall_clock_s:double,input_tokens:long,output_tokens:long,total_cost_usd:double>, _corrupt_record string"
)


def read_records(spark: SparkSession, glob: str, one_a_file: bool = True) -> DataFrame:
    """Audit records, one JSON document a file (or one a line), with the file they came from; unreadable ones are left out."""
    rows = spark.read.schema(RECORD).option("multiLine", one_a_file).option("mode", "PERMISSIVE").json(glob)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"))
    return rows.where("_corrupt_record IS NULL AND dataset IS NOT NULL").drop("_corrupt_record")


def baseline(records: DataFrame) -> DataFrame:
    """(dataset, attribute, baseline) from the records of cycle 1."""
    return records.where("cycle = 1").select("dataset", "attribute", F.upper("result.severity").alias("baseline"))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def write_summary(metrics: DataFrame, path: str) -> None:
    """{attribute, DisparateImpact, TheilIndex, BiasFlag} as JSON rows."""
    metrics.select("attribute", F.struct(F.col("di").alias("DisparateImpact"), F.col("theil").alias("TheilIndex"), F.col("bias_flag").alias("BiasFlag")).alias("metrics")).write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One table, partitioned by its split column."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def retained(old: DataFrame, new: DataFrame, key: str, papers: str = "papers") -> DataFrame:
    """Evidence by key: the new harvest, or the old one where the new is empty or holds only seeds."""
    n, o = F.col("new"), F.col("old")
    poor: Column = n.isNull() | (F.size(n) == 0) | F.forall(n, lambda p: p["source"] == "doi_seed")
    both = old.select(key, F.col(papers).alias("old")).join(new.select(key, F.col(papers).alias("new")), key, "full")
    return both.select(key, F.when(poor & o.isNotNull(), o).otherwise(n).alias(papers), (poor & o.isNotNull()).alias("kept_old"))


class EvidenceTable:
    """Evidence by key in versions: a merge writes the next version aside and then names it in the manifest.

    The manifest is a table to which each merge appends one row (version, folder, batch); readers follow its last version.
    The append is the switch: before it nobody sees the new files, after it everybody does, and a merge that stops in
    between leaves the table as it was. A batch that the manifest holds is not merged again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "attr", papers: str = "papers"):
        self.spark, self.path, self.key, self.papers = spark, path.rstrip("/"), key, papers

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema("version long, folder string, batch string").parquet(f"{self.path}/manifest")

    def _switch(self, version: int, df: DataFrame, batch: str) -> None:
        folder = f"v{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        row = self.spark.createDataFrame([(version, folder, batch)], "version long, folder string, batch string")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def create(self, df: DataFrame, batch: str) -> None:
        """The first version."""
        self._switch(0, df.select(self.key, self.papers), batch)

    def version(self) -> int:
        return self._manifest().agg(F.max("version")).first()[0]

    def read(self) -> DataFrame:
        last = self._manifest().orderBy(F.desc("version")).first()
        return self.spark.read.parquet(f"{self.path}/{last.folder}")

    def merge(self, new: DataFrame, batch: str) -> bool:
        """The new harvest over the table, old evidence winning over empty and seed-only rows; False if it was merged before."""
        if not self._manifest().where(F.col("batch") == batch).isEmpty():
            return False
        self._switch(self.version() + 1, retained(self.read(), new, self.key, self.papers).drop("kept_old"), batch)
        return True


def write_fitted(model: PipelineModel, bounds: DataFrame, path: str) -> None:
    """A fitted feature pipeline with the one row of bounds that belongs to it."""
    write_model(model, f"{path}/pipeline")
    bounds.write.mode("overwrite").parquet(f"{path}/bounds")


def read_fitted(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/bounds")
