"""A Merkle manifest of a data set: levels built bottom-up and persisted, proofs pushed top-down.

Nodes of a tree are numbered from 0. A pass gathers every 2 ** stride consecutive nodes of a tree into a block and folds the
block's levels, so that one shuffle builds stride levels; the blocks with all their levels are written to the checkpoint
folder, and their top nodes are the next pass's input. Proofs go the other way: each persisted table joins its blocks (the
children) to the nodes above them, and each child prepends its own siblings to the proof suffix that it inherits. Only block
numbers and suffixes are shuffled on the way down, never a leaf's whole proof; blocks have a fixed size, so no tree, however
large, meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import broadcast_few, durable, tasks_for

STRIDE = 6
SUFFIX = "array<struct<left:boolean,hash:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another, as UTF-8."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes(tree, ...) with idx, gapless from 0 in each tree in the given order, and n, the tree's number of nodes.

    Rows are range-partitioned by tree and order, so a large tree lies in many partitions; a row's number is its place in
    its partition and how many rows of its tree lie in earlier ones. Rows equal in order are interchangeable and spread.
    """
    spark = nodes.sparkSession
    tied = durable(nodes).withColumn("_tie", F.rand(11))
    keys = ["tree", *order, "_tie"]
    dealt = durable(tied.repartitionByRange(tasks_for(spark), *keys).sortWithinPartitions(*keys).drop("_tie"))
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.expr("monotonically_increasing_id() & 8589934591"))
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_start"), F.sum("_rows").over(tree).alias("n"))
    # One row for each partition and tree in it.
    return placed.join(broadcast_few(durable(starts)), ["tree", "_part"]).withColumn("idx", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def _blocks(nodes: DataFrame, stride: int, *payload: str) -> DataFrame:
    """(tree, block, n, members, levels) of nodes(tree, idx, n, hash, payload...): levels[k] holds the block's nodes k levels
    up. Every two consecutive nodes become one, a last single one too, for as long as the tree has several nodes."""
    pairs = "transform(sequence(0, (size(s.levels[size(s.levels) - 1]) - 1) div 2), j -> sha2(cast(concat(s.levels[size(s.levels) - 1][int(2 * j)], coalesce(get(s.levels[size(s.levels) - 1], int(2 * j + 1)), '')) as binary), 256))"
    fold = f"""aggregate(sequence(1, {stride}), named_struct('levels', array(transform(members, m -> m.hash)), 'left', n),
        (s, k) -> if(s.left > 1, named_struct('levels', concat(s.levels, array({pairs})), 'left', cast((s.left + 1) div 2 as bigint)), s), s -> s.levels)"""
    packed = nodes.groupBy("tree", F.shiftright("idx", stride).alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "hash", *payload))).alias("members")
    )
    return packed.withColumn("levels", F.expr(fold))


@dataclass
class Trees:
    """Persisted levels of one or many trees: passes[p] holds the blocks of pass p, tops(tree, hash) the trees' roots."""

    passes: list[DataFrame]
    tops: DataFrame
    stride: int


def build(nodes: DataFrame, *payload: str, stride: int = STRIDE) -> Trees:
    """The trees over nodes(tree, idx, n, hash, payload...), bottom-up; payload columns stay with the lowest level."""
    passes = []
    while True:
        blocks = durable(_blocks(nodes, stride, *payload))
        passes.append(blocks)
        nodes = blocks.select("tree", F.col("block").alias("idx"), F.shiftright(F.col("n") + ((1 << stride) - 1), stride).alias("n"), F.element_at("levels", -1)[0].alias("hash"))
        payload = ()
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return Trees(passes, nodes.select("tree", "hash"), stride)


def push(trees: Trees, above: DataFrame, *payload: str) -> DataFrame:
    """(tree, idx, hash, proof, ...) of all lowest nodes, from above(tree, suffix, ...), the proof suffix of each tree's top
    and what else goes down with it. proof lists one (left, hash) per level: the sibling and whether it stands left; hash is
    null where a node has none and is hashed alone."""
    own = """if(size(levels) = 1, array(), transform(sequence(0, size(levels) - 2), k -> named_struct('left', (shiftright(at, k) & 1) = 1, 'hash', get(levels[k], shiftright(at, k) ^ 1))))"""
    extra = [c for c in above.columns if c not in ("tree", "suffix")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for p in range(len(trees.passes) - 1, -1, -1):
        blocks = trees.passes[p].select("tree", "block", "levels", *(["members"] if p == 0 else []))
        children = blocks.join(above, ["tree", "block"]).select(
            "tree", "block", "suffix", "levels", *extra, F.posexplode(F.col("members") if p == 0 else F.col("levels")[0]).alias("at", "node")
        )
        proof = F.concat(F.expr(own).cast(SUFFIX), "suffix")
        idx = F.shiftleft("block", trees.stride) + F.col("at")
        if p:
            above = durable(children.select("tree", idx.alias("block"), proof.alias("suffix"), *extra))
    return children.select("tree", idx.alias("idx"), F.col("node.hash").alias("hash"), proof.alias("proof"), *[F.col(f"node.{c}").alias(c) for c in payload], *extra)


def folded(leaf: str, proof: str = "proof") -> Column:
    """The root that a leaf and its siblings give."""
    return F.expr(f"aggregate({proof}, {leaf}, (h, p) -> sha2(cast(concat(if(p.left, p.hash, ''), h, if(p.left, '', coalesce(p.hash, ''))) as binary), 256))")


def manifest(leaves: DataFrame, group: str, *payload: str, stride: int = STRIDE) -> DataFrame:
    """(payload..., leaf, subroot, root, proof) of leaves(group, order columns in payload, leaf): a tree per group over its
    leaves in order of the first payload column and the leaf's digest, and a tree over the groups' subroots in order of the
    group (null first, UTF-8 bytewise).

    A null group is a group of its own; nulls of the order column come first; rows that are equal are leaves of their own
    with equal digests. An empty table gives an empty table.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    nodes = numbered(leaves.select(key.alias("tree"), F.col("leaf").alias("hash"), *payload), payload[0], "hash")
    trees = build(nodes, *payload, stride=stride)
    subroots = durable(numbered(trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash"), "of"))
    over = build(subroots, "of", stride=stride)
    top = over.tops.first()
    root = F.lit(top.hash if top else None).cast("string").alias("root")
    start = over.tops.select("tree", F.expr("array()").cast(SUFFIX).alias("suffix"))
    down = durable(push(over, start, "of").select(F.col("of").alias("tree"), F.col("proof").alias("suffix"), F.col("hash").alias("subroot")))
    return push(trees, down, *payload).select(*payload, F.col("hash").alias("leaf"), "subroot", root, "proof")


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """A manifest of documents, with each document's proof checked against a leaf that may have been tampered with.

    Any column may be null (a null doc_id comes first in its lang and is never tampered with; a null n_chars stays null);
    rows that repeat are leaves of their own; other columns of the table are ignored; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaf = lambda n: digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang")], field(n), field(F.col("text")))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    leaves = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(hit, leaf(more)).alias("tampered"))
    out = manifest(leaves, "lang", "doc_id", "tampered").withColumn("shown", F.coalesce("tampered", "leaf"))
    siblings = digest(F.concat_ws("", F.transform("proof", lambda p: p.hash)))
    out = out.select("doc_id", "leaf", "subroot", "root", siblings.alias("proof_sha256"), folded("shown").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
