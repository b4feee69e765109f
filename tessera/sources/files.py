"""Files under names of their own: one row, one file."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions.tables import materialize, ship
from tessera.sources.graphs import graph_name, response_name


def write_files(rows: DataFrame, path: str, name: Column, text: Column) -> DataFrame:
    """A file for each row below ``path``; returns the names and sizes that were written.

    Each is written under a name of its task attempt and then moved, so a repeated task replaces it whole. Names are to
    be distinct; of rows that share one, either may stay. Rows with a null name or text have no file.
    """

    def save(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            sizes = []
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = value.encode()
                with store.open_output_stream(f"{base}/.{file}.{attempt}.tmp", compression=None) as sink:
                    sink.write(data)
                store.move(f"{base}/.{file}.{attempt}.tmp", f"{base}/{file}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    ship(rows.sparkSession)
    files = rows.select(name.alias("name"), text.alias("text")).where("name is not null and text is not null")
    return materialize(files.mapInArrow(save, "name string, bytes long"))


def write_graph_files(graphs: DataFrame, path: str) -> DataFrame:
    """Each graph as a JSON file under its canonical name, with missing values written as null."""
    return write_files(graphs, path, graph_name(F.col("case_id"), F.col("source"), F.col("agent_id")), F.to_json(F.struct(*S.GRAPH_FIELDS), {"ignoreNullFields": "false", "pretty": "true"}))


def write_report_files(reports: DataFrame, path: str) -> DataFrame:
    """Each nested discrepancy report as a JSON file named by case and student."""
    name = F.concat("case_id", F.lit("_"), "student_id", F.lit(".json"))
    return write_files(reports, path, name, F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false", "pretty": "true"}))


def write_response_files(responses: DataFrame, path: str) -> DataFrame:
    """Each raw response as a text file under its canonical name."""
    return write_files(responses, path, response_name(F.col("case_id"), F.col("source"), F.col("agent_id")), F.col("text"))
