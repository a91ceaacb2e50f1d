"""Near duplicates by SimHash: fingerprints, links at few differing bits, components.

Two fingerprints of 64 bits that differ in at most two bits agree, in one of
their two halves, up to one bit. So each fingerprint is filed under both halves
with one bit blanked, in all 32 places, and meets its partners in an equality
join; what meets is verified. A file with too many members is cut again by the
other half in the same way (16, then 8 bits), after which a file cannot hold
more than 2,048 different fingerprints. Copies share a fingerprint, so only
different ones are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, query, small, stored, table, utf8

SHINGLE, SEED, NEAR = 3, 42, 2
#: Files with more members are cut again.
MEMBERS = 4096
#: Shingles hashed at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles' XXH64, as a signed number; zero without words."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.concatenate((blanks, [len(line)]))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fingerprint`` (long) of each row; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            data = memoryview(data)
            prints = [fingerprint(bytes(data[at[i] : at[i + 1]]), shingle) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["key", "fingerprint"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return in_text_batches(rows).mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, fingerprint long").withColumnRenamed("key", key)


def _filed(rows: DataFrame, width: int) -> DataFrame:
    """Each row under every half of its ``width`` undecided bits with one bit blanked."""
    half = width // 2
    v, part = F.col("v"), (F.col("v") / half).cast("int")
    value = F.expr(f"shiftrightunsigned(fingerprint, base + {half} * (v div {half})) & {(1 << half) - 1}L & ~shiftleft(1L, v % {half})")
    own = v.cast("long") * (1 << half) + value
    filed = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    first = width == 64
    return filed.select(
        "fingerprint",
        (own if first else F.col("file")).alias("file"),
        (F.lit(0).cast("long") if first else F.col("within") * (1 << 21) + own + 1).alias("within"),
        (F.col("base") + half * (1 - part)).cast("int").alias("base"),
    )


def _chain(members: np.ndarray, near: int) -> list[tuple[int, int]]:
    """Links that join what can be reached inside one file, one fewer than it has members at most."""
    rest, found = members.view(np.uint64), []  # numpy counts the bits of a signed number's absolute value
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = np.bitwise_count(rest ^ x) <= near
            if hit.any():
                new, rest = rest[hit], rest[~hit]
                found += [(int(x), int(y)) for y in new]
                front.extend(new)
    return found


def _links(near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "within", "fingerprint")])
            own = own if held is None else np.concatenate((held, own), axis=1)
            cuts = np.flatnonzero((np.diff(own[0]) != 0) | (np.diff(own[1]) != 0)) + 1
            last = cuts[-1] if len(cuts) else 0
            held = own[:, last:]  # its file may go on in the next batch
            yield _of_files(own[:, :last], cuts[:-1], near)
        if held is not None:
            yield _of_files(held, np.zeros(0, np.int64), near)

    return run


def _of_files(own: np.ndarray, cuts: np.ndarray, near: int) -> pa.RecordBatch:
    found: list[tuple[int, int]] = []
    bounds = np.concatenate(([0], cuts, [own.shape[1]]))
    sizes = np.diff(bounds)
    for i in np.flatnonzero(sizes > 1):
        found += _chain(own[2, bounds[i] : bounds[i + 1]], near)
    a = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a.max(1) if len(a) else a[:, 0]), pa.array(a.min(1) if len(a) else a[:, 0])], ["a", "b"])


def links(prints: DataFrame, near: int = NEAR, members: int = MEMBERS) -> DataFrame:
    """Links (a, b) with a > b that connect the distinct values of ``fingerprint`` as all links at ``near`` bits do."""
    if not 0 <= near <= 2:
        raise ValueError("halves with one blank cover up to two differing bits")
    rows, found = prints.select("fingerprint").withColumn("base", F.lit(0)), None
    for width in (64, 32, 16):
        filed = _filed(rows, width)
        crowded = None
        if width > 16:
            crowded = stored(filed.groupBy("file", "within").count().filter(F.col("count") > members).select("file", "within"), "crowded")
            crowded = None if crowded.isEmpty() else small(crowded)
        calm = filed if crowded is None else filed.join(crowded, ["file", "within"], "left_anti")
        own = (
            calm.select("file", "within", "fingerprint").repartition("file", "within")
            .sortWithinPartitions("file", "within").mapInArrow(_links(near), "a long, b long").distinct()
        )
        found = own if found is None else found.union(own).distinct()
        if crowded is None:
            break
        rows = filed.join(crowded, ["file", "within"])
    return found


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of the links (a, b), a > b; root is the component's smallest node.

    Each round hangs larger neighbours, then smaller ones, on the smallest
    neighbour; the rounds are stored and grow with the logarithm of the longest chain.
    """
    edges = stored(edges, "links")
    seen = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError("the components did not settle")


def representatives(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, near: int = NEAR
) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``: that with the smallest key, of equal keys the first row.

    Groups are of rows, so rows with null keys and rows that share a key are in
    groups of their texts too; a null key comes last. Texts without words are one
    group. All columns are kept as they are.
    """
    row, own = "_row", "_own"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    named = numbered.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row")).alias(own), F.col(text).alias("text"))
    groups = near_duplicates(named, own, "text", shingle, near)
    gone = groups.filter(F.col(f"{own}.row") != F.col("component_id.row")).select(F.col(f"{own}.row").alias(row))
    return numbered.join(small(stored(gone, "near-copies")), row, "left_anti").select(docs.columns)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (long), component_id (smallest key reachable).

    Rows without words share fingerprint zero and are linked like any other.
    Rows with a null key keep their row and never name a component unless all its
    keys are null. Repeated rows each get a row. Other columns are not looked at.
    """
    prints = stored(fingerprints(docs, key, text, shingle).withColumnRenamed(key, "key"), "fingerprints")
    first = stored(prints.groupBy("fingerprint").agg(F.min("key").alias("first")), "distinct-fingerprints")
    roots = components(links(first, near))
    linked = first.join(roots, first["fingerprint"] == roots["node"]).select("fingerprint", "first", "root")
    # a root is itself no node of the stars
    own = roots.select(F.col("root").alias("fingerprint")).distinct().join(first, "fingerprint").select("fingerprint", "first", F.col("fingerprint").alias("root"))
    linked = stored(linked.union(own), "linked")
    names = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(names, "root").select("fingerprint", "component_id")
    named = first.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(named, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


@query("op5_simhash")
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of each document."""
    out = near_duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
