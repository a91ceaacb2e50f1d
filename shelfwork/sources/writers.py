"""Writers. Tables go to Parquet or CSV folders; nothing passes through the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import upsert_latest
from ..scale import kept


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite") -> None:
    """CSV with header; quotes are doubled, white space is kept."""
    writer = df.write.mode(mode).options(
        header=True, quote='"', escape='"', quoteAll=quote_all,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    writer.csv(path)


def save_parts(df: DataFrame, root: str, mode: str, text_columns: Sequence[str], key: str = "row_id", label: str = "prdtypecode") -> None:
    """Texts, labels and image paths of one split, with the row key in each."""
    parts = {
        f"X_{mode}": [key, *text_columns],
        f"y_{mode}": [key, label],
        f"images_{mode}": [key, "image_name", "image_path", "image_path_preprocessed"],
    }
    for name, columns in parts.items():
        write_csv(df.select(*columns), f"{root}/{name}")


def append_rows(df: DataFrame, path: str) -> None:
    """Append error rows, batch replies or report rows to a table."""
    df.write.mode("append").parquet(path)


def write_images(images: DataFrame, path: str, label: str = "prdtypecode") -> None:
    """Pixel structs, one folder per class."""
    images.write.mode("overwrite").partitionBy(label).parquet(path)


def write_files(files: DataFrame, root: str, path: str, content: str) -> DataFrame:
    """One file for each row, at ``path`` below ``root``, written by the tasks; returns (path, bytes) of what is there now.

    ``root`` is a folder that all executors reach, as a path or an address that Arrow's
    file systems know. A repeated task writes the same files again; rows with nulls write none.
    """
    address = root if "://" in root or root.startswith("file:") else f"file://{root}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = FileSystem.from_uri(address.replace("file:/", "file:///", 1) if re.match("file:/[^/]", address) else address)
        made = set()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{folder}/{name}"
                if (above := target.rpartition("/")[0]) not in made:
                    system.create_dir(above)
                    made.add(above)
                with system.open_output_stream(target) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64())], ["path", "bytes"])

    rows = files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).dropna()
    return kept(rows.mapInArrow(run, "path string, bytes long"), "files")


def write_submission(df: DataFrame, path: str, key: str = "row_id", code: str = "prdtypecode") -> None:
    write_csv(df.select(key, code), path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Hash buckets of a result store.
BUCKETS = 64


def _manifest(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    """The newest finished version of a store and the folder of each bucket in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [0]
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done.append(int(name[1:]))
    version = max(done)
    if not version:
        return 0, {}
    rows = spark.read.schema("bucket int, folder string").json(f"{root}/manifest/v{version}").collect()  # a row for each bucket
    return version, {r["bucket"]: r["folder"] for r in rows}


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def read_results(spark: SparkSession, root: str, schema, keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The newest finished version of a result store; with ``keys`` only their buckets are read, and only their rows kept."""
    _, folders = _manifest(spark, root)
    if keys is not None:
        wanted = {r[0] for r in keys.select(_bucket(key)).distinct().collect()}  # at most BUCKETS numbers
        folders = {b: f for b, f in folders.items() if b in wanted}
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders.values()])
    return rows if keys is None else rows.join(keys.select(key).distinct(), key, "left_semi")


def store_results(spark: SparkSession, root: str, new: DataFrame, key: str, version: str) -> DataFrame:
    """Keyed result store: the stored and the new results, latest per key.

    Keys are hashed into buckets. A write reads and writes only the buckets that its
    keys lie in, into a new folder, and then commits a manifest that names the folder of
    each bucket; so a failed write leaves the last version intact, no table is
    overwritten while it is read, and the rest of the store is not touched.
    """
    schema = new.schema
    last, folders = _manifest(spark, root)
    new = kept(new, "results")
    touched = sorted(r[0] for r in new.select(_bucket(key)).distinct().collect())  # at most BUCKETS numbers
    old = [f"{root}/{folders[b]}" for b in touched if b in folders]
    rows = upsert_latest(spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema), new, key, version)
    target = f"data/v{last + 1}"
    bucketed = rows.withColumn("store_bucket", _bucket(key)).repartition("store_bucket")
    bucketed.write.mode("overwrite").partitionBy("store_bucket").parquet(f"{root}/{target}")
    folders |= {b: f"{target}/store_bucket={b}" for b in touched}
    named = spark.createDataFrame(sorted(folders.items()), "bucket int, folder string").coalesce(1)
    named.write.mode("overwrite").json(f"{root}/manifest/v{last + 1}")
    return read_results(spark, root, schema)


def sink_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Outcome counters: rows per status."""
    return df.groupBy(status).agg(F.count("*").alias("n"))
