"""Results as JSON: one document a session, and what has been written already."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS, PARAMETERS = "results", "run_params.json"


def session_documents(results: DataFrame) -> DataFrame:
    """(session, units): the summaries of a session's units as one JSON object, by unit id.

    Keys are escaped by ``to_json``; summaries are JSON already.
    """
    entry = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("unit_id").cast("string").alias("k"))), r'^\{"k":(.*)\}$', 1), F.lit(":"), F.col("summary"))
    listed = results.groupBy("session").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return listed.select("session", F.concat(F.lit("{"), F.array_join("e", ","), F.lit("}")).alias("units"))


def write_results(results: DataFrame, path: str, shared: Mapping[str, object]) -> None:
    """Write one JSON line a session under ``path``/results/session=.../.

    A session's document replaces the one that is there; those of other sessions stay.
    """
    named = F.regexp_extract(F.to_json(F.struct(F.col("session").cast("string").alias("session_id"))), r"(?s)^\{(.*)\}$", 1)
    before = json.dumps(shared)[:-1] + (", " if shared else "")
    document = F.concat(F.lit(before), named, F.lit(', "units": '), F.col("units"), F.lit("}"))
    session_documents(results).select("session", document.alias("value")).write.partitionBy("session").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(
        f"{path}/{RESULTS}"
    )


def written_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session) of the documents under ``path``; none if there are none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("value string, session string").text(f"{path}/{RESULTS}").select("session").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "session string")


def pending(sessions: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """``sessions`` without those in ``done``."""
    return sessions if overwrite else sessions.join(done.select("session").distinct(), "session", "left_anti")


def export_files(spark: SparkSession, path: str, folder: str) -> list[str]:
    """One ``<session>.json`` a session in a local folder, written one after the other."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for row in spark.read.schema("value string, session string").text(f"{path}/{RESULTS}").toLocalIterator():
        out.append(f"{folder}/{row.session}.json")
        with open(out[-1], "w") as file:
            json.dump(json.loads(row.value), file, indent=2)
            file.write("\n")
    return sorted(out)


def save_parameters(spark: SparkSession, folder: str, parameters: Mapping[str, object], sessions: list[str]) -> str:
    """What a run was asked for, beside its results, on whatever file system they are."""
    path = f"{folder}/{PARAMETERS}"
    told = {"created": datetime.datetime.now(datetime.UTC).isoformat(), "parameters": dict(parameters), "sessions": sessions}
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(json.dumps(told, indent=2, default=str).encode() + b"\n"))
    finally:
        out.close()
    return path
