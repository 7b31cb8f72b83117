"""A Merkle manifest of a table: a trie over ranks, built without a global sort.

Every row is a leaf, the SHA-256 of its fields, each as its UTF-8 byte count, a colon and its value, or "-" where it is null.  Within a group (language)
leaves ascend by id.  While several nodes remain, every FANOUT consecutive ones become the SHA-256 of their hex digests;
what remains is the group's root.  The groups' roots, nulls first and then by their UTF-8 bytes, make the manifest's root likewise.

Ranks: histograms over the digits of the id, finest first, each rolled up from the one below; sums of smaller siblings down
the levels give every bucket of 512 ids its offset, a window within the bucket the rest.  A window sees the children of one digit.  Buckets that hold
more rows than ids (repeated or null ids, a third of all rows maybe) are counted on by digits of the leaf and of the row's number.

Tree: a node is keyed by its group and the digits of its rank in base FANOUT.  STOREY levels at a time are reduced by the longest prefix within blocks of
512 consecutive leaves, which are one key of the shuffle; the blocks' roots are the nodes of the next storey.  Proofs
come down the same way: a block gets its own siblings above once, its leaves add those within.  No task ever sees more than a block, whatever
the number of rows in a group.

Null ids come first.  Rows of one id ascend by the first 12 hexadecimal digits of their leaf, and identical rows have ranks one after another.  A null group
is a group.  Fields of any length are hashed whole.  An empty table gives no rows.  Only the named columns are read, into columns
of this module's, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._scratch import Scratch

FANOUT_BITS, STOREY = 3, 3
FANOUT = 1 << FANOUT_BITS
BLOCK_BITS = FANOUT_BITS * STOREY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: ids of a bucket, and digits above it, in bits; a bucket of over CROWDED rows is counted by further digits
BUCKET_BITS, DIGIT_BITS, CROWDED = 9, 14, 4 << 9
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def offsets(counted: DataFrame, keys: list[str]) -> DataFrame:
    """counted has keys, coarse to fine, and n rows for each: how many rows of the first key's group come before (`before`), and how many it has (`total`)."""
    levels = [counted]
    for i in range(len(keys) - 1, 1, -1):
        levels.append(levels[-1].groupBy(*keys[:i]).agg(F.sum("n").alias("n")))
    out = None
    for i, level in enumerate(reversed(levels), 2):
        siblings = Window.partitionBy(*keys[: i - 1])
        level = level.withColumn("smaller", F.coalesce(F.sum("n").over(siblings.orderBy(keys[i - 1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        if out is None:
            out = level.withColumn("total", F.sum("n").over(siblings)).withColumnRenamed("smaller", "before")
        else:
            out = level.join(out.drop("n"), keys[: i - 1]).withColumn("before", F.col("before") + F.col("smaller")).drop("smaller")
    return out


def ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (g, u, b, prefix, row_no, ...) with rank, from 0 in each group, and n, the group's rows."""
    upper = [F.shiftright("b", DIGIT_BITS * i).alias(f"b{i}") for i in (3, 2, 1)]
    keys = ["g", "b3", "b2", "b1", "b"]
    buckets = scratch.cut(offsets(rows.groupBy("g", *upper, "b").agg(F.count(F.lit(1)).alias("n")), keys), "buckets")
    crowd = None
    if buckets.filter(f"n > {CROWDED}").limit(1).count():
        # told apart on salted keys: no task gets a crowded bucket whole
        salts = buckets.filter(f"n > {CROWDED}").select("g", "b", F.col("before").alias("start"), "total").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        marked = scratch.cut(rows.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(64)).cast("int")).join(salts, ["g", "b", "salt"], "left").drop("salt"), "marked")
        rows, crowd = marked.filter("start is null").drop("start", "total"), marked.filter("start is not null")
    at = rows.join(buckets.filter(f"n <= {CROWDED}").select("g", "b", "before", "total"), ["g", "b"])
    within = Window.partitionBy("g", "b").orderBy("u", "prefix", "row_no")
    out = at.withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    if crowd is not None:
        digits = {"x0": "u", "x1": "shiftright(prefix, 36)", "x2": "shiftright(prefix, 24)", "x3": "shiftright(prefix, 12)", "x4": "prefix"}
        digits |= {"x5": "shiftright(row_no, 48)", "x6": "shiftright(row_no, 33)", "x7": "shiftright(row_no, 22)", "x8": "shiftright(row_no, 11)"}
        crowd = crowd.withColumns({k: F.expr(v) for k, v in digits.items()}).withColumn("gb", F.concat_ws("/", F.col("b").cast("string"), "g"))
        fine = offsets(crowd.groupBy("gb", *digits).agg(F.count(F.lit(1)).alias("n")), ["gb", *digits]).select("gb", *digits, "before")
        crowd = crowd.join(fine, ["gb", *digits])
        last = Window.partitionBy("gb", *digits).orderBy("row_no")
        out = out.unionByName(crowd.withColumn("rank", F.col("start") + F.col("before") + F.row_number().over(last) - 1).select(*out.columns))
    return out.withColumnRenamed("total", "n").drop("before", "u", "b", "prefix", "row_no")


def _nodes(level: int) -> str:
    """SQL: how many nodes a group of n has that many levels up."""
    return f"shiftright(n + {(1 << FANOUT_BITS * level) - 1}L, {FANOUT_BITS * level})"


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes (g, idx, n, h, own): a row per block of consecutive nodes, with the block's digest and its nodes as a tree."""
    d = nodes.withColumn("block", F.shiftright("idx", BLOCK_BITS)).repartition("g", "block")
    d = d.select("g", "block", "n", "idx", "h", F.col("own").alias("kids"))
    for level in range(STOREY):
        d = d.groupBy("g", "block", "n", F.shiftright("idx", FANOUT_BITS).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "h", "kids"))).alias("kids"))
        d = d.select("g", "block", "n", F.col("up").alias("idx"), F.expr(f"if({_nodes(level)} > 1, sha2(concat_ws('', kids.h), 256), kids[0].h)").alias("h"), "kids")
    return d.drop("idx")


def _unfold(blocks: DataFrame, carried: list[str]) -> DataFrame:
    """blocks with path, the siblings above: g, idx, h, own and the whole path of every node."""
    d = blocks.withColumnRenamed("h", "top")
    for level in reversed(range(STOREY)):
        d = d.select("g", "n", "path", *carried, F.col("kids.h").alias("run"), F.posexplode("kids").alias("pos", "kid"))
        step = f"array(named_struct('left', concat_ws('', slice(run, 1, pos)), 'right', concat_ws('', slice(run, pos + 2, {FANOUT}))))"
        d = d.select("g", "n", *carried, F.expr(f"if({_nodes(level)} > 1, concat({step}, path), path)").alias("path"), "kid.idx", "kid.h", "kid.kids")
    return d.withColumnRenamed("kids", "own")


def _climb(nodes: DataFrame, most: int, scratch: Scratch, name: str, crown: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """Every node with its path, storey by storey; crown turns the groups' roots (g, h) into (g, path, carried...)."""
    blocks = scratch.cut(_blocks(nodes), name)
    if most <= 1 << BLOCK_BITS:
        above, keys = crown(blocks.select("g", "h")), ["g"]  # a group is one block here
    else:
        block_nodes = blocks.select("g", F.col("block").alias("idx"), F.expr(_nodes(STOREY)).alias("n"), "h", F.lit(None).cast("int").alias("own"))
        above = _climb(block_nodes, -(-most >> BLOCK_BITS), scratch, f"{name}-up", crown, carried).select("g", F.col("idx").alias("block"), "path", *carried)
        keys = ["g", "block"]
    return _unfold(blocks.join(above, keys), carried)


def _group_order(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """g and idx, the group's place: sorted by ranges, counted by range."""
    d = groups.select("g").distinct().repartitionByRange("g").sortWithinPartitions("g").select("g", F.monotonically_increasing_id().alias("at"))
    d = scratch.cut(d, "groups").withColumn("part", F.shiftright("at", 33))
    parts = d.groupBy("part").agg(F.count(F.lit(1)).alias("c"))  # a row per range
    parts = parts.withColumn("start", F.sum("c").over(Window.orderBy("part")) - F.col("c")).drop("c")
    return d.join(parts, "part").select("g", (F.col("start") + F.expr("at & 8589934591L")).alias("idx"))


def manifest(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path for each row of docs; path holds the siblings left and right on each level, leaf first.

    With tampered, columns to read in place of fields, `tampered` is the leaf they give where `when` is true, and the leaf elsewhere.
    """
    scratch = Scratch(spark)
    col = lambda c: F.col(f"`{c}`")
    leaf = leaf_digest([col(f) for f in fields])
    other = F.when(when, leaf_digest([(tampered or {}).get(f, col(f)) for f in fields])) if when is not None else F.lit(None).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), col(group_col).cast("string")), F.lit("")).alias("g"), col(id_col).cast("long").alias("doc_id"), leaf.alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("row_no"),
    )
    rows = scratch.cut(rows, "leaves").withColumns(
        {
            "u": F.coalesce(F.col("doc_id"), F.lit(0).cast("long")),
            "b": F.coalesce(F.shiftrightunsigned(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), BUCKET_BITS), F.lit(-1).cast("long")),
            "prefix": F.conv(F.substring("leaf", 1, 12), 16, 10).cast("long"),
        }
    )
    nodes = ranked(rows, scratch).select("g", F.col("rank").alias("idx"), "n", F.col("leaf").alias("h"), F.struct("doc_id", "tampered").alias("own"))
    nodes = scratch.cut(nodes, "ranked")
    most = nodes.agg(F.max("n")).first()[0] or 0

    def whole(tops: DataFrame) -> DataFrame:
        return tops.select("g", F.expr(f"cast(array() as {_PATH})").alias("path"), F.col("h").alias("root"))

    def crown(tops: DataFrame) -> DataFrame:
        order = _group_order(tops, scratch)
        n = order.agg(F.max("idx")).first()[0]
        groups = tops.join(order, "g").select(F.lit("").alias("g"), "idx", F.lit((n or 0) + 1).cast("long").alias("n"), "h", F.col("g").alias("own"))
        up = _climb(groups, (n or 0) + 1, scratch, "crown", whole, ["root"])
        return up.select(F.col("own").alias("g"), "path", F.col("h").alias("subroot"), "root")

    got = _climb(nodes, most, scratch, "blocks", crown, ["subroot", "root"])
    return got.select(F.col("own.doc_id").alias("doc_id"), F.col("h").alias("leaf"), F.coalesce("own.tampered", "h").alias("tampered"), "subroot", "root", "path")


def proof_digest(path: str = "path") -> Column:
    return F.expr(f"sha2(concat_ws('', flatten(transform({path}, x -> array(x.left, x.right)))), 256)")


def fold(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    return F.expr(f"aggregate({path}, {leaf}, (h, x) -> sha2(concat(x.left, h, x.right), 256))")


def tamper_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The manifest of docs, and what is found when the texts of about a third of the documents have been lower-cased (A-Z)."""
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = manifest(spark, docs, tampered={"text": lowered}, when=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    got = got.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), fold("tampered").alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))
