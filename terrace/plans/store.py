"""Snapshot tables: each commit writes new versions of some tables and one
manifest that names the current version of all.  A reader sees a commit whole
or not at all, and nothing that is being read is overwritten."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Schemas of the graph and the catalog.
SCHEMAS = {
    "documents": "id string, hash string, name string, path string, status string, created_at timestamp, finished_at timestamp, chars int, chunks int, graph_built boolean, error string",
    "chunks": "id string, doc_id string, index int, text string, start int, extraction string",
    "entities": "id string, key string, name string, type string, descriptions array<string>, mention_count bigint, description string, embedding array<float>",
    "aliases": "key string, entity_id string",
    "mentions": "chunk_id string, entity_id string",
    "related": "src string, dst string, type string, weight double, descriptions array<string>, chunk_ids array<string>",
    "communities": "id string, level int, leiden_level int, size bigint, title string, summary string, content_hash string, is_top boolean, embedding array<float>, parent_id string",
    "entity_community": "entity_id string, community_id string",
    "meta": "key string, value string",
    "datasets": "id string, file_name string, file_hash string, path string, name string, description string, status string, row_count bigint, column_count int, sheet string, other_sheets array<string>, created_at double, updated_at double, error string, embedding array<float>",
    "dataset_columns": (
        "dataset_id string, position int, name string, dtype string, non_null bigint, null_pct double, distinct bigint, distinct_capped boolean, is_unique boolean, examples array<string>, "
        "top_values array<string>, categories array<string>, key_sample array<string>, min string, max string, mean double, avg_len double, description string, embedding array<float>"
    ),
}
GRAPH = ("documents", "chunks", "entities", "aliases", "mentions", "related", "communities", "entity_community", "meta")
CATALOG = ("datasets", "dataset_columns")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        folder = self._path(f"{self.root}/_commits")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if not s.getPath().getName().startswith((".", "_"))) if self._fs.exists(folder) else []

    def current(self) -> dict[str, str]:
        names = self._manifests()
        if not names:
            return {}
        lines = self.spark.read.text(f"{self.root}/_commits/{names[-1]}", wholetext=True).head()
        return json.loads(lines[0])

    def read(self, name: str) -> DataFrame:
        at = self.current().get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], SCHEMAS[name])

    def answers(self) -> DataFrame:
        """(text, extraction): what a model has said about chunks, kept from the moment it was said."""
        at = f"{self.root}/answers"
        kind = "text string, extraction string"
        return self.spark.read.schema(kind).parquet(at) if self._fs.exists(self._path(at)) else self.spark.createDataFrame([], kind)

    def add_answers(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/answers")

    def commit(self, **tables: DataFrame) -> None:
        """New versions of ``tables``, visible together."""
        now = self.current()
        for name, df in tables.items():
            kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
            at = f"{name}/{uuid.uuid4().hex}"
            df.select([df[f.name].cast(f.dataType) for f in kinds]).write.parquet(f"{self.root}/{at}")
            now[name] = at
        number = len(self._manifests())
        out = self._fs.create(self._path(f"{self.root}/_commits/.{number:08d}"), False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not self._fs.rename(self._path(f"{self.root}/_commits/.{number:08d}"), self._path(f"{self.root}/_commits/{number:08d}")):
            raise RuntimeError("another commit came first")

    def reset(self, names=GRAPH) -> None:
        """Empty tables; documents and catalog are reset apart."""
        self.commit(**{n: self.spark.createDataFrame([], SCHEMAS[n]) for n in names})

    def guard(self, model_id: str) -> None:
        """Refuse to mix vectors of two models."""
        found = self.read("meta").where("key = 'embedding'").head()
        if found is None or self.read("entities").isEmpty():
            self.commit(meta=self.spark.createDataFrame([("embedding", model_id)], SCHEMAS["meta"]))
        elif found.value != model_id:
            raise ValueError(f"the graph holds vectors of {found.value}; {model_id} does not match")
