r"""Exact duplicates by two passes of Bloom filtering.  DataFrame functions only.

Texts are equal when they are identical after deleting [\x20\x09-\x0D]; the SHA-256 of what is left stands for the text.  Each text
is read once and leaves a narrow row: digest, code points, and a cell, the low CELL_BITS bits of a second hash.

First pass: a counting Bloom filter with one counter per cell, kept as a table: counters are summed within each task and then by
cell, so a text that a third of all rows hold is one counter.  It grows with the data and is never gathered.
Second pass: the cells counted twice or more go into a register-blocked Bloom filter, 64-bit words in which a cell sets three bits.
It has at most MAX_WORDS words, which bounds what is broadcast.  A row whose bits aren't all set is alone and passes straight
through.  Only the others shuffle.  With more repeated cells than the filter holds well, more rows shuffle in vain; results are the same.

Groups of at least HOT rows are marked by a second set of bits.  Their rows are dealt to SALTS keys, and only their group's verdict is
repeated for each key.

Null counts as empty, and empty texts (or of blanks alone) are equal to one another.  Of equal texts the row with the most code points stays, then
the smallest doc_id, nulls last; of repeated rows of one document that tie, exactly one stays.  An empty table gives no rows; only the
id and the text are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._scratch import Scratch

CELL_BITS = 40
#: words of the broadcast filter at most (a power of two); a word serves four repeated cells where that many suffice
MAX_WORDS = 1 << 20
HOT, SALTS = 1000, 64


def normalised(text: str) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    for blank in " \t\n\v\f\r":
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, points (code points of the whole text), cell and a number of the row."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).alias("points"), normalised(text_col).alias("t"))
    return d.select("doc_id", "points", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").bitwiseAND((1 << CELL_BITS) - 1).alias("cell"), F.monotonically_increasing_id().alias("row_no"))


def repeated_cells(measured: DataFrame) -> DataFrame:
    """First pass: (cell, n) of the cells that two rows or more fall into."""
    return measured.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _mask(cell: str) -> str:
    """Three bits of a word, from bits of the cell that don't choose the word."""
    return " | ".join(f"shiftleft(1L, cast(shiftright({cell}, {s}) & 63 as int))" for s in (22, 28, 34))


def bloom_words(repeated: DataFrame, words: int) -> DataFrame:
    """The second pass's filter: word, bits, and the bits of cells that are hot."""
    r = repeated.withColumn("mask", F.expr(_mask("cell")))
    return r.groupBy(F.expr(f"cell & {words - 1}L").alias("word")).agg(F.expr("bit_or(mask)").alias("bits"), F.expr(f"bit_or(if(n >= {HOT}, mask, 0L))").alias("hot_bits"))


def duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs."""
    if max_words < 1 or max_words & (max_words - 1) or max_words > 1 << 22:
        raise ValueError("max_words must be a power of two, of 4,194,304 at most")
    scratch = Scratch(spark)
    measured = scratch.cut(measure(docs, id_col, text_col), "measured")
    repeated = scratch.cut(repeated_cells(measured), "repeated")
    words = min(max_words, 1 << max(0, (repeated.count() // 4 - 1).bit_length()))
    # bounded by max_words rows of three numbers
    found = measured.join(F.broadcast(bloom_words(repeated, words)), F.expr(f"cell & {words - 1}L = word"), "left")
    found = found.withColumn("mask", F.expr(_mask("cell")))
    found = found.select("doc_id", "points", "digest", "row_no", F.expr("coalesce(bits & mask = mask, false)").alias("maybe"), F.expr("coalesce(hot_bits & mask = mask, false)").alias("hot"))

    alone = found.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = found.filter("maybe").withColumn("salt", F.expr(f"if(hot, cast(pmod(xxhash64(row_no), {SALTS}) as int), 0)"))
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")
    groups = maybe.groupBy("digest", "hot").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")).filter("group_size > 1")
    groups = groups.select("digest", "group_size", "best", F.explode(F.expr(f"if(hot, sequence(0, {SALTS - 1}), array(0))")).alias("salt"))
    met = maybe.join(groups, ["digest", "salt"], "left").select(
        "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("best.row_no") == F.col("row_no"), F.lit(True)).alias("kept"), "digest",
    )
    return alone.unionByName(met).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")
