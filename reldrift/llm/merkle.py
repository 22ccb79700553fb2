"""A Merkle manifest of a table, and proofs read from it by content-addressed descent.

Every row is a leaf; leaves of one tree ascend, and every ``FANOUT`` consecutive nodes
become one until one is left, the subroot.  The subroots, in the order of their trees,
become the root likewise.  A node's digest is sha256 over its children's, all as hex text.

Rows are numbered without a window over a whole tree: they are dealt out by ranges, a range
numbers its own, and the rows of the ranges before it are added.  ``FANOUT ** HEIGHT``
consecutive nodes then form a pack, which one task hashes ``HEIGHT`` levels up, so a tree of
n leaves takes log(n) / log(729) rounds and the row of a pack is bounded.  A pack is stored
under its top digest with a digest-to-children record for each inner node.

Proofs descend from the root.  A request names a node by its digest and the leaves it asks
for by the rank digits they share; the pack stored under that digest is joined, and from its
top one record after another is looked up: the rank digit picks the child, the children not
picked are put down as a segment of the path.  All leaves below a node share one request
until their digits part, so the join of the last round, not of each level, has as many
leaves as were asked for.  At the leaf the segments are reversed.

Rows are ordered by the order column and their digest, nulls first; equal rows are leaves
of their own in one range, and have the same digest but each its own proof.  A null tree is a
tree of its own before all others.  An empty table has no root and no rows.  Columns that
are not named are not read.
"""

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

FANOUT = 3
HEIGHT = 6  # levels of a pack
PACK = FANOUT**HEIGHT

_SEGMENT = "struct<digit:int, others:array<binary>>"
_RECORD = "struct<digest:binary, children:array<binary>>"


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields in order, each ``-`` if null, else its bytes in UTF-8, ``:`` and itself."""
    def written(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(written, fields)), 256))


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add the row's number from 0 in its key, in ascending order, nulls first.

    No task gets a whole key: ranges of (key, order) number their own rows, on top of the
    rows of the key in earlier ranges.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "merkle-ranged")
    sizes = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", *[F.col(k).alias(f"_of_{k}") for k in keys], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    same = ranged["_range"] == sizes["_range"]
    for k in keys:
        same = same & ranged[k].eqNullSafe(sizes[f"_of_{k}"])
    place = F.row_number().over(inside) - 1
    return ranged.withColumn("_place", place.cast("long")).join(sizes, same).select(
        *[ranged[c] for c in rows.columns], (F.col("_before") + F.col("_place")).alias(out)
    )


def _node(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def _raise(nodes: list[bytes], whole: bool) -> tuple[bytes, dict[bytes, list[bytes]]]:
    """(top, records) of consecutive nodes: until one is left, or ``HEIGHT`` levels if the tree goes on."""
    records, level = {}, 0
    while len(nodes) > 1 or (not whole and level < HEIGHT):
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        nodes = [_node(run) for run in runs]
        records.update(zip(nodes, runs))
        level += 1
    return nodes[0], records


def _packed(batches):
    """(tree, block, size, nodes) -> the pack with its top and records."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))]))
    for batch in batches:
        tops, records = [], []
        for size, nodes in zip(batch.column("size"), batch.column("nodes")):
            top, inner = _raise(nodes.as_py(), size.as_py() <= PACK)
            tops.append(top)
            records.append([{"digest": d, "children": c} for d, c in inner.items()])
        given = ["tree", "block", "size"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in given], pa.array(tops, pa.binary()), pa.array(records, kind)], names=[*given, "top", "records"]
        )


def _pack_of(rank: str) -> Column:
    return F.call_function("div", F.col(rank), F.lit(PACK).cast("long"))


def _packs(nodes: DataFrame) -> DataFrame:
    """(tree, rank, digest, size) -> packs of one round; ``size`` is how many nodes the tree has in it."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda n: n["digest"])
    grouped = nodes.groupBy("tree", _pack_of("rank").alias("block")).agg(F.max("size").alias("size"), ordered.alias("nodes"))
    return materialize(grouped.mapInArrow(_packed, f"tree bigint, block bigint, size bigint, top binary, records array<{_RECORD}>"), "merkle-packs")


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(packs of every round, (tree, digest) of the subroots)."""
    rounds, tops = [], []
    while True:
        packs = _packs(nodes)
        rounds.append(packs)
        tops.append(packs.where(F.col("size") <= PACK).select("tree", F.col("top").alias("digest")))
        packs = packs.where(F.col("size") > PACK)
        if packs.isEmpty():
            return rounds, reduce(DataFrame.unionByName, tops)
        nodes = packs.select(
            "tree", F.col("block").alias("rank"), F.col("top").alias("digest"),
            F.call_function("div", F.col("size") + (PACK - 1), F.lit(PACK).cast("long")).alias("size"),
        )


def _pick(top: bytes, records: dict[bytes, list[bytes]], place: int) -> tuple[bytes, list[dict]]:
    """From a pack's top down to its node number ``place``: that node, and the segments on the way."""
    height, node = 0, top
    while height < HEIGHT and node in records:  # levels of the pack, along its first children
        node, height = records[node][0], height + 1
    path, node = [], top
    for level in reversed(range(height)):
        children, digit = records[node], place // FANOUT**level % FANOUT
        path.append({"digit": digit, "others": children[:digit] + children[digit + 1 :]})
        node = children[digit]
    return node, path


def _requests(batch: pa.RecordBatch):
    """The rows of requests joined with packs, records as a mapping."""
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
        yield row, {r["digest"]: r["children"] for r in row["records"]}


def _descended(batches):
    """Requests for packs -> requests for those of their nodes that are asked for."""
    path = pa.list_(pa.struct([("digit", pa.int32()), ("others", pa.list_(pa.binary()))]))
    schema = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("digest", pa.binary()), ("subroot", pa.binary()), ("path", path)])
    for batch in batches:
        out = []
        for row, records in _requests(batch):
            for place in row["asked"]:
                node, segments = _pick(row["top"], records, place)
                out.append({
                    "tree": row["tree"], "block": row["block"] * PACK + place, "digest": node,
                    "subroot": row["subroot"], "path": row["path"] + segments,
                })
        yield pa.RecordBatch.from_pylist(out, schema)


def fold(leaf: bytes, path: list[dict]) -> bytes:
    """The root that follows from a leaf and its path, the leaf's own run first."""
    for step in path:
        run = list(step["others"])
        run.insert(step["digit"], leaf)
        leaf = _node(run)
    return leaf


def _proved(batches):
    """Requests for packs of leaves -> a proof for every leaf that is asked for."""
    for batch in batches:
        asked, found = [], []
        for row, records in _requests(batch):
            for leaf in row["asked"]:
                node, segments = _pick(row["top"], records, leaf["place"])
                path = (row["path"] + segments)[::-1]
                siblings = "".join([d.hex() for step in path for d in step["others"]])
                asked.append(leaf)
                found.append((
                    node.hex(), row["subroot"].hex(), hashlib.sha256(siblings.encode()).hexdigest(), fold(leaf["claimed"], path).hex(),
                ))
        columns = list(zip(*found)) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array([a["id"] for a in asked], batch.schema.field("asked").type.value_type.field("id").type),
             *[pa.array(c, pa.string()) for c in columns]],
            names=["id", "leaf", "subroot", "proof_sha256", "folded_root"],
        )


@dataclass
class Manifest:
    """The store: packs by round, those of leaves first, and the same of the tree over the subroots."""

    leaves: DataFrame            # (tree, rank, id, leaf, claimed)
    rounds: list[DataFrame]      # packs of the trees
    top_rounds: list[DataFrame]  # packs of the tree of subroots
    root: bytes | None


def build(rows: DataFrame, tree: str, order: str, leaf: Column, claimed: Column | None = None) -> Manifest:
    """Manifest of ``rows``; ``claimed`` is the digest a holder of the row presents, by default the leaf's."""
    given = rows.select(
        F.col(tree).alias("key"), F.col(order).alias("id"), leaf.alias("leaf"), (leaf if claimed is None else claimed).alias("claimed")
    )
    ranked = materialize(numbered(given, ["key"], ["id", "leaf"], "rank"), "merkle-ranked")
    sizes = ranked.groupBy("key").agg(F.count("*").alias("size"))
    trees = materialize(numbered(sizes, [], ["key"], "tree"), "merkle-trees").withColumnRenamed("key", "_key")
    leaves = ranked.join(trees, F.col("key").eqNullSafe(F.col("_key"))).select("tree", "rank", "id", "leaf", "claimed", "size")
    leaves = materialize(leaves, "merkle-leaves")
    rounds, subroots = _grown(leaves.withColumnRenamed("leaf", "digest"))
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "digest", F.lit(trees.count()).cast("long").alias("size"))
    top_rounds, root = _grown(tops)
    found = root.head()
    return Manifest(leaves.drop("size"), rounds, top_rounds, bytes(found["digest"]) if found else None)


def _asked_above(asked: DataFrame) -> DataFrame:
    """Which nodes of the next round stand above those asked for: (tree, block, asked)."""
    place = F.pmod("block", F.lit(PACK).cast("long")).cast("int")
    return asked.groupBy("tree", _pack_of("block").alias("block")).agg(F.collect_set(place).alias("asked"))


def prove(spark: SparkSession, manifest: Manifest, ids: DataFrame | None = None) -> DataFrame:
    """(id, leaf, subroot, proof_sha256, folded_root) of all leaves, or of those whose id is in ``ids``.

    The proof is the siblings level by level from the leaf to the root, and here its digest;
    ``folded_root`` is what follows from it and the claimed digest.
    """
    leaves = manifest.leaves if ids is None else manifest.leaves.join(ids.select("id").distinct(), "id", "left_semi")
    leaf = F.struct(F.pmod("rank", F.lit(PACK).cast("long")).cast("int").alias("place"), "id", "claimed")
    asked = [leaves.groupBy("tree", _pack_of("rank").alias("block")).agg(F.collect_list(leaf).alias("asked"))]
    for _ in manifest.rounds[1:]:
        asked.append(_asked_above(asked[-1]))
    trees = asked[0].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("block")).distinct()
    top_asked = []
    for _ in manifest.top_rounds:
        top_asked.append(_asked_above(top_asked[-1] if top_asked else trees))

    schema = f"tree bigint, block bigint, digest binary, subroot binary, path array<{_SEGMENT}>"
    start = [(0, 0, manifest.root, None, [])] if manifest.root else []
    requests = spark.createDataFrame(start, schema)

    def stored(packs: DataFrame, wanted: DataFrame, requests: DataFrame) -> DataFrame:
        joined = packs.drop("size").join(wanted, ["tree", "block"]).join(requests, ["tree", "block"])
        return joined.where(F.col("top") == F.col("digest")).drop("digest")

    for packs, wanted in reversed(list(zip(manifest.top_rounds, top_asked))):
        requests = stored(packs, wanted, requests).mapInArrow(_descended, schema)
    subroots = requests.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "digest", F.col("digest").alias("subroot"), "path")
    subroots = requests = materialize(subroots, "merkle-requests")
    for packs, wanted in reversed(list(zip(manifest.rounds, asked))[1:]):
        below = stored(packs, wanted, requests).mapInArrow(_descended, schema)
        requests = materialize(below.unionByName(subroots), "merkle-requests")
    kind = manifest.leaves.schema["id"].dataType.simpleString()
    proved = "leaf string, subroot string, proof_sha256 string, folded_root string"
    return stored(manifest.rounds[0], asked[0], requests).mapInArrow(_proved, f"id {kind}, {proved}")


def verified(spark: SparkSession, manifest: Manifest, ids: DataFrame | None = None) -> DataFrame:
    """The proofs with the root, and whether the claimed digest leads to it."""
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    return prove(spark, manifest, ids).withColumn("root", root).withColumn("verified", F.col("folded_root") == root)
