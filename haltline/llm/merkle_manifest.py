"""A dataset's content digest as a tree of digests, and proofs for single rows (operator 12).

Rows of a source stand in order; every sixteen consecutive digests are hashed into one until one is left,
and the digests of the sources are joined likewise into the root. What is stored is content-addressed: one
record from a digest to its children, whatever trees hold it. A proof is found by descent from the root: the
base-16 digits of a row's rank choose the child at every height, the children not chosen are collected, and
the segments are reversed into leaf-to-root order.

All requests below one node descend together, so a height moves one row for each node, not one for each
request, and no digest near the root becomes a hot key. Everything runs in SQL expressions.

Null and empty values: a null field is hashed as "-", an empty text as "0:". Rows without a source form the
first tree, rows without an id come first in theirs, rows of one id are ordered by their digest. An empty
table has no root and no rows. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haltline.operators.ranking import rank_by_range
from haltline.session import keep_table

#: A node has up to 2 ** FAN_BITS children.
FAN_BITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before:string,after:string>>"


def digest_of(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each as its UTF-8 length, a colon and its value, or a dash if null."""
    parts = [
        F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))
        for text in (field.cast("string") for field in fields)
    ]
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """leaves(tree, rank, doc_id, leaf, …), trees(tree, place, digest, height) of the sources, records(digest,
    children); `root` with the height of the tree above the sources, None for an empty table."""

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    root: tuple[str, int] | None


def write_manifest(leaves: DataFrame, path: str) -> None:
    """Store the trees over leaves(source, doc_id, leaf, …) in the folder `path`.

    Further columns stay with their leaf. No source is sorted in one place: ranks come from key ranges.
    """
    keyed = leaves.withColumn(
        # Null first, then by UTF-8 bytes.
        "tree", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ranked = rank_by_range(keyed, ["tree"], order).withColumn("rank", F.col("rank") - 1)
    ranked.write.parquet(f"{path}/leaves")
    spark = leaves.sparkSession
    stored = spark.read.parquet(f"{path}/leaves")
    tops, records = _grow(stored.select("tree", "rank", F.col("leaf").alias("digest")))
    above = rank_by_range(tops.withColumn("all", F.lit("")), ["all"], [F.col("tree")])
    above.select("tree", (F.col("rank") - 1).alias("place"), "digest", "height").write.parquet(
        f"{path}/trees"
    )
    trees = spark.read.parquet(f"{path}/trees")
    root, more = _grow(
        trees.select(F.lit("").alias("tree"), F.col("place").alias("rank"), "digest")
    )
    root.write.parquet(f"{path}/root")
    records.unionByName(more).dropDuplicates(["digest"]).write.parquet(f"{path}/records")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("leaves", "trees", "records")]
    root = spark.read.parquet(f"{path}/root").select("digest", "height").first()
    return Manifest(*tables, None if root is None else (root.digest, root.height))


def _grow(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last digest of every tree over nodes(tree, rank, digest), and the records on the way there."""
    tops: DataFrame | None = None
    records: DataFrame | None = None
    height = 0
    while True:
        child = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        runs = keep_table(
            nodes.groupBy("tree", F.shiftright("rank", FAN_BITS).alias("run"))
            .agg(child.alias("nodes"))
            .select("tree", "run", F.transform("nodes", lambda node: node["digest"]).alias("children"))
            # A first run of one node is all there is: its tree is done.
            .withColumn("done", (F.col("run") == 0) & (F.size("children") == 1))
            .withColumn(
                "digest",
                F.when(F.col("done"), F.col("children")[0]).otherwise(
                    F.sha2(F.array_join("children", ""), 256)
                ),
            )
        )
        done = runs.filter("done").select("tree", "digest", F.lit(height).alias("height"))
        inner = runs.filter(~F.col("done"))
        kept = inner.select("digest", "children")
        tops = done if tops is None else tops.unionByName(done)
        records = kept if records is None else records.unionByName(kept)
        if inner.isEmpty():
            return tops, records
        nodes = inner.select("tree", F.col("run").alias("rank"), "digest")
        height += 1


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """requests(tree, rank, …) with `found`, the leaf at that place, `path` from leaf to root, `subroot`, `root`.

    A segment of the path is what stands before and after the chosen child, as one string each. Requests
    for places that do not exist have no row; those asked for more than once have one row each.
    """
    spark = requests.sparkSession
    root, tallest = manifest.root or ("", 0)
    start = spark.createDataFrame([("", root, tallest)], "tree string, digest string, height int")
    sources = _descend(
        start.withColumn("root", F.col("digest")).withColumn("path", F.array().cast(_PATH)),
        manifest.trees.select(
            F.lit("").alias("tree"), F.col("place").alias("rank"), "height", F.col("tree").alias("source_tree")
        ),
        manifest.records,
        tallest,
    )
    deepest = manifest.trees.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]
    found = _descend(
        sources.select(
            F.col("source_tree").alias("tree"),
            "digest",
            "height",
            "root",
            F.col("digest").alias("subroot"),
            "path",
        ),
        requests,
        manifest.records,
        deepest,
    )
    return found.withColumn("path", F.reverse("path")).withColumnRenamed("digest", "found")


def _descend(starts: DataFrame, requests: DataFrame, records: DataFrame, tallest: int) -> DataFrame:
    """From starts(tree, digest, height, path, …) down to the nodes that requests(tree, rank, …) ask for."""
    wanted = [requests]
    for _ in range(tallest):
        upper = wanted[-1].select("tree", F.shiftright("rank", FAN_BITS).alias("rank"))
        wanted.append(keep_table(upper.distinct()))
    front: DataFrame | None = None
    for height in range(tallest, 0, -1):
        begun = (
            starts.filter(F.col("height") == height).drop("height").withColumn("place", F.lit(0).cast("long"))
        )
        front = begun if front is None else begun.unionByName(front)
        front = _step(front, records, wanted[height - 1])
    lone = starts.filter(F.col("height") == 0).drop("height")
    lone = lone.join(requests.filter(F.col("rank") == 0).withColumnRenamed("rank", "place"), "tree")
    return lone if front is None else front.unionByName(lone)


def _step(front: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One height down: the children asked for, the others kept as a segment of the path."""
    parent = F.shiftright("rank", FAN_BITS)
    digit = F.col("rank").bitwiseAND((1 << FAN_BITS) - 1).cast("int")
    chosen = (
        front.join(records, "digest").drop("digest").join(wanted.withColumn("place", parent), ["tree", "place"])
    )
    segment = F.struct(
        F.array_join(F.slice("children", F.lit(1), digit), "").alias("before"),
        F.array_join(F.slice("children", digit + 2, F.lit(1 << FAN_BITS)), "").alias("after"),
    )
    return (
        chosen.withColumn("digest", F.get("children", digit))
        .filter(F.col("digest").isNotNull())
        .withColumn("path", F.concat("path", F.array(segment)))
        .withColumn("place", F.col("rank"))
        .drop("children", "rank")
    )


def proof_digest(path: Column) -> Column:
    """SHA-256 of all collected children, level by level."""
    segments = F.transform(path, lambda part: F.concat(part["before"], part["after"]))
    return F.sha2(F.array_join(segments, ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(
        path, leaf, lambda node, part: F.sha2(F.concat(part["before"], node, part["after"]), 256)
    )


def verified_rows(docs: DataFrame, path: str, altered: Column | None = None) -> DataFrame:
    """Build the manifest of `docs` in `path`, prove every row, and fold its text or an altered one.

    Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified). `altered` is what the text is at
    the time of the check, the text itself if missing; a row whose text is another one is not verified.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("text").cast("string").alias("text"),
        (F.col("text") if altered is None else altered).cast("string").alias("altered"),
    )
    fields = [F.col(name) for name in FIELDS]
    changed = ~F.col("altered").eqNullSafe(F.col("text"))
    presented = F.when(changed, digest_of([*fields[:-1], F.col("altered")]))
    leaves = plain.select("source", "doc_id", digest_of(fields).alias("leaf"), presented.alias("presented"))
    write_manifest(leaves, path)
    manifest = read_manifest(docs.sparkSession, path)
    proved = prove(manifest, manifest.leaves.select("tree", "rank", "doc_id", "presented"))
    return proved.select(
        "doc_id",
        F.col("found").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("presented", "found"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
