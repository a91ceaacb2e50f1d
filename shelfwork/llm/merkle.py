"""Merkle manifest of a dataset: a tree of digests for each part, a tree over their roots, proofs for each row.

Nodes are labelled with the interval of leaf ranks that they cover. Levels are
taken in bands of BAND: a bucket holds the nodes of a band below one node, at
most 2**BAND leaves of it, whatever the size of the tree. Inside its bucket a
node's parent is the one a level up whose interval contains its own, and its
siblings are what is left of the parent's interval without its own. Bands join
by the interval at which one ends and the next begins, from the root down, so
that each join has one row for each bucket and no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import query, small, stored, table

#: Levels of a tree in a band.
BAND = 10
PATH = "array<struct<left:boolean,digest:string>>"


def field(column: Column) -> Column:
    """``-`` for null, else the value's bytes in UTF-8, counted and told apart by a colon."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_digest(*columns: Column) -> Column:
    """sha256 of a record's fields, lower-case hexadecimal."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` from 0 within ``tree``, in the order of columns, and the tree's size ``n``.

    Ranges of (tree, order) are sorted on their own and shifted by the counts of
    the ranges before them. Rows that are equal in all of these go by their place
    in the input, so that a crowd of them is cut into ranges too.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "_place"]
    dealt = stored(rows, "leaves").withColumn("_place", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_place")
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = dealt.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = W.partitionBy("tree")  # a row for each range that the tree lies in
    before = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        "tree", "_range", F.sum("_n").over(whole).alias("n"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    dealt = dealt.join(small(stored(shifts, "shifts")), ["tree", "_range"])
    return dealt.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def _steps(n: Column) -> Column:
    """0 to n - 1; none if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _shifted(number: Column, by: Column) -> Column:
    return F.call_function("shiftright", number, by)


def _above(level: Column) -> Column:
    """The nodes over a level's nodes: every two of them, and what is left."""

    def parent(i: Column) -> Column:
        first, second = F.get(level, 2 * i), F.get(level, 2 * i + 1)
        return F.struct(
            first["start"].alias("start"), F.coalesce(second["end"], first["end"]).alias("end"),
            F.sha2(F.concat(first["digest"], F.coalesce(second["digest"], F.lit(""))), 256).alias("digest"),
        )

    return F.transform(_steps(_shifted(F.size(level) + 1, F.lit(1))), parent)


def _siblings(i: Column, levels: Column, depth: Column) -> Column:
    """PATH from member ``i`` of a bucket to its top: the other child of each parent, null where there is none."""

    def sibling(at: Column) -> Column:
        nodes, over = F.get(levels, at), _shifted(i, at + 1)
        own, parent = F.get(nodes, _shifted(i, at)), F.get(F.get(levels, at + 1), over)
        inside = F.filter(
            F.slice(nodes, 2 * over + 1, 2),
            lambda c: (c["start"] >= parent["start"]) & (c["end"] <= parent["end"]) & (c["start"] != own["start"]),
        )
        return F.get(F.transform(inside, lambda c: F.struct((c["start"] < own["start"]).alias("left"), c["digest"].alias("digest"))), 0)

    return F.transform(_steps(depth), sibling)


def _band(members: DataFrame, keep: list[str], bits: int) -> DataFrame:
    """A row for each bucket (tree, block) of members (tree, n, pos, start, end, digest, *keep), with the nodes above them."""
    own = F.sort_array(F.collect_list(F.struct("pos", "start", "end", "digest", *keep)))
    buckets = members.groupBy("tree", F.shiftright("pos", bits).alias("block")).agg(F.first("n").alias("n"), own.alias("members"))
    depth = F.when(F.col("n") > (1 << bits), F.lit(bits)).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    buckets = buckets.withColumn("depth", depth.cast("int"))
    leaves = F.transform("members", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["digest"].alias("digest")))
    rising = F.aggregate(_steps(F.col("depth")), F.array(leaves), lambda levels, _: F.concat(levels, F.array(_above(F.element_at(levels, -1)))))
    return buckets.withColumn("levels", rising)


def tree_paths(members: DataFrame, keep: list[str], over=None, bits: int = BAND) -> DataFrame:
    """(tree, *keep, path, subroot, root) of each member (tree, n, rank, digest, *keep).

    ``over`` gets the trees' roots (tree, digest) and returns for each tree the
    (tree, path, root) above it; without it the trees' roots are the roots.
    """
    bands, own = [], keep
    members = members.withColumn("pos", F.col("rank")).withColumn("start", F.col("rank")).withColumn("end", F.col("rank") + 1)
    while True:
        bands.append(stored(_band(members, own, bits), "band"))
        top = F.get(F.element_at("levels", -1), 0)
        tops = bands[-1].select(
            "tree", F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"), F.col("block").alias("pos"),
            top["start"].alias("start"), top["end"].alias("end"), top["digest"].alias("digest"),
        )
        members, own = stored(tops, "tops"), []
        if (members.agg(F.max("n")).first()[0] or 1) <= 1:
            break
    roots = members.select("tree", "digest")
    above = roots.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root")) if over is None else over(roots)
    above = roots.join(small(stored(above, "above")), "tree").select("tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "root", F.col("path").alias("higher"))
    for k, band in reversed(list(enumerate(bands))):
        mine = keep if k == 0 else []
        each = F.transform("members", lambda m, i: F.struct(
            m["pos"].alias("pos"), *[m[c].alias(c) for c in mine], _siblings(i, F.col("levels"), F.col("depth")).alias("path")
        ))
        joined = band.join(small(stored(above, "paths")), ["tree", "block"])
        rows = joined.select("tree", "subroot", "root", "higher", F.explode(each).alias("m"))
        path = F.concat("m.path", "higher")
        if k:
            above = rows.select("tree", F.col("m.pos").alias("block"), "subroot", "root", path.alias("higher"))
    return rows.select("tree", *[F.col(f"m.{c}").alias(c) for c in keep], path.alias("path"), "subroot", "root")


def manifest(
    docs: DataFrame, fields: list[str], part: str, key: str, also: dict[str, Column] | None = None, bits: int = BAND
) -> DataFrame:
    """One row per row of ``docs``: key, *also, leaf, subroot, root, path (siblings from the leaf up, null where there is none).

    A leaf is the digest of ``fields``; ``also`` are further columns made from the
    row in the same reading. Each value of ``part`` (null is one, and the first) has
    its tree, its leaves in the order of ``key``, null first; equal keys go by
    their leaves, and repeated rows, which have equal leaves, by their places. The
    trees' roots, in the order of ``part`` in bytes, have a tree again. Null and empty
    fields differ; texts count whole; an empty table has no rows. Other
    columns are not looked at.
    """
    also = also or {}
    made = [c.alias(f"also_{i}") for i, c in enumerate(also.values())]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit("")).alias("tree"), F.col(key).alias("key"),
        record_digest(*[F.col(c) for c in fields]).alias("digest"), *made,
    )
    keep = ["key", "leaf", *[f"also_{i}" for i in range(len(made))]]

    def over(roots: DataFrame) -> DataFrame:
        parts = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), "digest"), ["part"])
        return tree_paths(parts, ["part"], bits=bits).select(F.col("part").alias("tree"), "path", "root")

    leaves = ranked(rows, ["key", "digest"]).withColumn("leaf", F.col("digest"))
    out = tree_paths(leaves, keep, over, bits)
    return out.select(
        F.col("key").alias(key), *[F.col(f"also_{i}").alias(name) for i, name in enumerate(also)], "leaf", "subroot", "root", "path"
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""

    def up(digest: Column, s: Column) -> Column:
        left = F.when(s["left"], s["digest"]).otherwise("")
        return F.sha2(F.concat(left, digest, F.when(~s["left"], s["digest"]).otherwise("")), 256)

    return F.aggregate(path, leaf, up)


def path_digest(path: Column) -> Column:
    """sha256 of all siblings on a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPERED = 7

_SQL_FIELD = "coalesce(strlen(({0})::varchar)::varchar || ':' || ({0})::varchar, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in FIELDS) + ")"
_SQL_CHANGED = "sha256(" + " || ".join(_SQL_FIELD.format("n_chars + 1" if c == "n_chars" else c) for c in FIELDS) + ")"
_SQL_CRC = """xor(4294967295, list_reduce(
    [4294967295::bigint] || list_transform(range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i + 1, 1))::bigint),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
_SQL = f"""
with recursive leaves as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by lang) as n
    from (select doc_id, lang, {_SQL_LEAF} as leaf, case when {_SQL_CRC} % {TAMPERED} = 0 and n_chars is not null then {_SQL_CHANGED} else {_SQL_LEAF} end as shown from documents)),
nodes as (
    select lang, 0 as level, r as i, leaf as d, n from leaves
    union all
    select lang, level + 1, i // 2, sha256(string_agg(d, '' order by i)), (n + 1) // 2 from nodes where n > 1 group by lang, level, i // 2, n),
tops as (select lang, d as subroot, row_number() over (order by lang nulls first) - 1 as r, count(*) over () as n from nodes where n = 1),
higher as (
    select 0 as level, r as i, subroot as d, n from tops
    union all
    select level + 1, i // 2, sha256(string_agg(d, '' order by i)), (n + 1) // 2 from higher where n > 1 group by level, i // 2, n),
low as (
    select lang, r, 0 as level, shown as d, '' as proof, n from leaves
    union all
    select l.lang, l.r, l.level + 1, sha256(case when s.d is null then l.d when (l.r >> l.level) & 1 = 1 then s.d || l.d else l.d || s.d end), l.proof || coalesce(s.d, ''), (l.n + 1) // 2
    from low l left join nodes s on s.lang is not distinct from l.lang and s.level = l.level and s.i = xor(l.r >> l.level, 1) where l.n > 1),
high as (
    select l.lang, l.r, t.r as i, 0 as level, l.d, l.proof, t.n from low l join tops t on t.lang is not distinct from l.lang where l.n = 1
    union all
    select h.lang, h.r, h.i, h.level + 1, sha256(case when s.d is null then h.d when (h.i >> h.level) & 1 = 1 then s.d || h.d else h.d || s.d end), h.proof || coalesce(s.d, ''), (h.n + 1) // 2
    from high h left join higher s on s.level = h.level and s.i = xor(h.i >> h.level, 1) where h.n > 1)
select l.doc_id, l.leaf, t.subroot, root.d as root, sha256(h.proof) as proof_sha256, h.d as folded_root, h.d = root.d as verified
from leaves l join high h on h.lang is not distinct from l.lang and h.r = l.r and h.n = 1
join tops t on t.lang is not distinct from l.lang cross join (select d from higher where n = 1) root
"""


@query("op13_merkle", _SQL)
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of each document; rows of which n_chars was changed do not verify."""
    names = [F.col(c) for c in FIELDS]
    more = F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    shown = record_digest(*[F.when(changed, more).otherwise(c) if name == "n_chars" else c for name, c in zip(FIELDS, names, strict=True)])
    out = manifest(table(spark, folder, "documents"), FIELDS, "lang", "doc_id", {"shown": shown})
    out = out.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded(F.col("shown"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
