"""The layered Parquet lake: datasets under bronze, silver, gold and marts, with a content digest for each in a manifest.

One layout: a dataset is a directory of ``part_key=...`` partitions (a whole
write has one).  All paths go through Hadoop's file systems, so a lake can lie
in any store that Spark reads.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("bronze", "silver", "gold", "marts")
VOLATILE = ("retrieved_at",)  # provenance, not content
PARTITION = "part_key"
MANIFEST_SCHEMA = "dataset string, hash string, rows long, columns array<string>, written_at string, source string, note string, bytes long, partitions array<string>"


def content_digest(df: DataFrame) -> str:
    """Sixteen hex digits of a frame's content; see counted_digest."""
    return counted_digest(df)[0]


def counted_digest(df: DataFrame) -> tuple[str, int]:
    """Sixteen hex digits of a frame's content, and its rows: of rows in any order, of columns in any order, without volatile columns.

    Each row's sha256 is cut into four 60-bit numbers, and the sums and count of
    rows are hashed with the schema: one aggregation, however many rows.
    """
    names = sorted(c for c in df.columns if c not in VOLATILE and c != PARTITION)
    types = dict(df.dtypes)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)
    sums = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]).first()
    text = json.dumps([[[c, types[c]] for c in names], [str(x) for x in sums]])
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:16], sums["n"]


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, layer: str, dataset: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"no such layer: {layer!r}")
        return f"{self.root}/{layer}/{dataset}"

    def exists(self, layer: str, dataset: str) -> bool:
        p = self._path(self.path(layer, dataset))
        return self._fs.exists(p) and len(self._fs.listStatus(p)) > 0

    # -- manifest: one small JSON file for each dataset, replaced by rename
    def _entry(self, layer: str, dataset: str) -> str:
        return f"{self.root}/_manifest/{layer}.{dataset}.json"

    def _record(self, layer: str, dataset: str, source: str, note: str, key: str, fresh: DataFrame, known: dict) -> str:
        """Enters one written partition; what the entry knows of the others is kept, so they aren't read."""
        import hashlib

        digest, n = counted_digest(fresh)
        hashes = {**dict(zip(known.get("partitions", []), known.get("partition_hashes", []), strict=True)), key: digest}
        rows = {**dict(zip(known.get("partitions", []), known.get("partition_rows", []), strict=False)), key: n}
        columns = list(dict.fromkeys([*known.get("columns", []), *(c for c in fresh.columns if c != PARTITION)]))
        keys = sorted(hashes)
        whole = hashes[keys[0]] if len(keys) == 1 else hashlib.sha256("".join(hashes[k] for k in keys).encode()).hexdigest()[:16]
        size = self._fs.getContentSummary(self._path(self.path(layer, dataset))).getLength()
        entry = {"dataset": f"{layer}/{dataset}", "hash": whole, "rows": sum(rows[k] for k in keys), "columns": columns, "written_at": datetime.now(UTC).isoformat(), "source": source, "note": note, "bytes": size, "partitions": keys, "partition_hashes": [hashes[k] for k in keys], "partition_rows": [rows[k] for k in keys]}
        self.put(self._entry(layer, dataset), json.dumps(entry))
        return whole

    def put(self, path: str, text: str) -> None:
        """Writes a small file whole: readers see the old text or the new one."""
        jvm = self.spark._jvm
        target, fresh = self._path(path), self._path(path + ".new")
        stream = self._fs.create(fresh, True)
        stream.write(text.encode())
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, target, options)

    def manifest_entry(self, layer: str, dataset: str) -> dict | None:
        path = self._entry(layer, dataset)
        if not self._fs.exists(self._path(path)):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def summary(self) -> DataFrame:
        """The manifest: dataset, rows, hash, bytes, source and the rest, in order of name."""
        folder = f"{self.root}/_manifest"
        if not self._fs.exists(self._path(folder)):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).json(folder).orderBy("dataset")

    # -- writing
    def write(self, layer: str, dataset: str, df: DataFrame, source: str = "", note: str = "") -> str:
        """Replaces the dataset; returns its digest."""
        path = self.path(layer, dataset)
        df.withColumn(PARTITION, F.lit("all")).write.mode("overwrite").option("compression", "zstd").partitionBy(PARTITION).parquet(path)
        return self._record(layer, dataset, source, note, "all", self.read(layer, dataset), {})

    def append(self, layer: str, dataset: str, df: DataFrame, partition: str | None = None, source: str = "", note: str = "") -> str:
        """Writes one partition (today's, if none is named); the same partition is replaced, older ones are neither read nor touched."""
        key = partition or datetime.now(UTC).strftime("%Y-%m-%d")
        path = f"{self.path(layer, dataset)}/{PARTITION}={key}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self._record(layer, dataset, source, note, key, self.spark.read.parquet(path), self.manifest_entry(layer, dataset) or {})

    # -- reading
    def read(self, layer: str, dataset: str) -> DataFrame:
        """All partitions; columns that only some have are NULL in the others."""
        if not self.exists(layer, dataset):
            raise FileNotFoundError(self.path(layer, dataset))
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(layer, dataset)).drop(PARTITION)

    def partitions(self, layer: str, dataset: str) -> list[str]:
        return sorted(s.getPath().getName().split("=", 1)[1] for s in self._fs.listStatus(self._path(self.path(layer, dataset))) if "=" in s.getPath().getName())

    def verify(self) -> dict[str, bool]:
        """Whether each dataset still has the digest of its manifest entry; a missing one doesn't."""
        out = {}
        for name in [r[0] for r in self.summary().select("dataset").collect()]:
            layer, dataset = name.split("/", 1)
            entry = self.manifest_entry(layer, dataset)
            try:
                out[name] = all(content_digest(self.spark.read.parquet(f"{self.path(layer, dataset)}/{PARTITION}={k}")) == h for k, h in zip(entry["partitions"], entry["partition_hashes"], strict=True))
            except Exception:
                out[name] = False
        return out

    def register_views(self) -> list[str]:
        """A temporary view layer_dataset for every dataset, partitioned ones too."""
        made = []
        for name in [r[0] for r in self.summary().select("dataset").collect()]:
            layer, dataset = name.split("/", 1)
            if self.exists(layer, dataset):
                view = name.replace("/", "_").replace("-", "_").replace(".", "_")
                self.read(layer, dataset).createOrReplaceTempView(view)
                made.append(view)
        return made

    def keys(self) -> list[str]:
        """Names (layer/dataset) of the manifest, in order."""
        return [r[0] for r in self.summary().select("dataset").collect()]

    def query(self, sql: str) -> DataFrame:
        self.register_views()
        return self.spark.sql(sql)
