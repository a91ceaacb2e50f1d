"""Checks and small table-level operators on columns and keys."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scale import join_dim


def require_columns(df: DataFrame, columns: Sequence[str], on_missing: str = "warn") -> list[str]:
    """The requested columns that exist; missing ones warn or raise."""
    missing = [c for c in columns if c not in df.columns]
    if missing and on_missing == "error":
        raise ValueError(f"missing columns: {missing}")
    for c in missing:
        warnings.warn(f"column {c!r} not found, skipped", stacklevel=2)
    return [c for c in columns if c in df.columns]


def on_columns(df: DataFrame, columns: Sequence[str], function, on_missing: str = "warn") -> DataFrame:
    """Apply a column function to every requested column that exists."""
    found = require_columns(df, columns, on_missing)
    return df.withColumns({c: function(F.col(c)) for c in found})


def output_column(column: str, model: str) -> str:
    """Name of the column a model writes."""
    return f"{column}_{model.replace(':', '_').replace('.', '_')}"


def with_paths(df: DataFrame, roots: dict[str, str], image="imageid", product="productid", label="prdtypecode") -> DataFrame:
    """Image name and the raw, preprocessed and grey paths."""
    name = T.image_name(image, product)
    in_class = F.concat(F.col(label).cast("string"), F.lit("/"), name)
    return df.withColumns(
        {
            "image_name": name,
            "image_path": F.concat(F.lit(roots["raw"]), name),
            "image_path_preprocessed": F.concat(F.lit(roots["preprocessed"]), in_class),
            "image_path_greyscale": F.concat(F.lit(roots["grey"]), in_class),
        }
    )


def with_labels(features: DataFrame, labels: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Features with their labels by row key: ``left`` keeps all, ``inner`` needs both."""
    return features.join(labels, key, how)


def rows_at(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``."""
    return df.join(keys.select(key), key, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys``."""
    return df.join(keys.select(key), key, "left_anti")


def first_existing(df: DataFrame, key: str, candidates: str, listing: DataFrame, file: str) -> DataFrame:
    """The first of a row's candidate names that the listing holds, null when none does."""
    tried = df.select(key, F.posexplode(candidates).alias("_rank", file))
    hits = tried.join(listing.select(file).distinct(), file, "left_semi")
    best = hits.groupBy(key).agg(F.min_by(file, "_rank").alias(file))
    return df.drop(candidates).join(best, key, "left")


def write_back(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` where ``changes`` has a new value for the row's key."""
    new = changes.select(key, F.col(column).alias("_new"))
    return (
        df.join(new, key, "left")
        .withColumn(column, F.coalesce("_new", column))
        .drop("_new")
    )


def keep_first(df: DataFrame, value: str, key: str, scope: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest key per value (and scope); keys are unique.

    Only digests and keys are grouped: copies merge before the shuffle, so a text
    that a third of the rows share costs no single task, and no text is sorted.
    The rows themselves are picked by key.
    """
    digest = F.sha2(F.col(value).cast("string"), 256).alias("_digest")
    firsts = df.select(*scope, digest, key).groupBy(*scope, "_digest").agg(F.min(key).alias(key))
    return df.join(firsts.select(key), key, "left_semi")


def drop_repeats(df: DataFrame, text: str, key: str, scope: Sequence[str] = (), junk: str = ";") -> DataFrame:
    """Drop rows with a null, then repeated texts (keep first) and texts equal to ``junk``."""
    return keep_first(df.na.drop("any").where(F.col(text) != junk), text, key, scope)


def repeated_texts(df: DataFrame, text: str, key: str) -> DataFrame:
    """Groups of equal texts: first key and number of rows."""
    groups = df.groupBy(F.md5(text).alias("text_md5")).agg(F.count("*").alias("n"), F.min(key).alias("first_key"))
    return groups.where("n > 1").select("text_md5", "n", "first_key")


def find_text(df: DataFrame, column: str, needle: str, key: str) -> DataFrame:
    """The first row (by key) whose column holds the needle."""
    return df.where(F.contains(F.col(column), F.lit(needle))).orderBy(key).limit(1)


def with_names(df: DataFrame, code: str, names: DataFrame, name: str, as_: str) -> DataFrame:
    """Look up the name of a code; null when unknown."""
    dim = names.select(F.col("code").alias(code), F.col(name).alias(as_))
    return join_dim(df, dim, [code], "left")
