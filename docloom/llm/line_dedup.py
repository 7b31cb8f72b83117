r"""Line deduplication by winnowing over line hashes.

Lines are the \n-separated parts of a text, compared without outer blanks; lines of blanks only are
passed over.  A line counts as one unit per UNIT_WORDS words begun, so that a run is measured by its lines and by its
words.  Of each WINDOW successive shingles of NOISE units the one with the smallest hash (the last one of equals) is selected,
and the selected ones alone are fingerprints: runs shorter than NOISE units are never matched, and
every run of NOISE + WINDOW - 1 units (five short lines, or one line of over 40 words) that two places share
has a fingerprint in common.

Each fingerprint is joined with its first place, by (doc_id, line), and the two places are extended line by line
both ways as far as they are equal.  The lines of the later place go, within one document as well, with the
blank lines between them.  A line goes only if an equal one stands earlier, so a first copy always
stays.  Of a repeated run of NOISE + WINDOW - 1 units or more at most WINDOW - 1 units at either end are left, and those
only if the fingerprints next to them first occur elsewhere, without the run's ends.

Null texts stay null, empty ones empty; texts of any length are read whole.  Rows with a null doc_id are kept as they are and are
nobody's source.  Rows of one doc_id and one text are one document and are all cleaned alike; a doc_id's
other texts are documents after it (in order of their hashes).  Other columns stay as they are; one named n_removed_lines is replaced.
An empty table gives an empty one.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _bytes as B
from ._scratch import Scratch

#: words to a unit, units to a shingle, shingles to a window
UNIT_WORDS, NOISE, WINDOW = 10, 3, 3
#: a place that very many others repeat is dealt to so many keys
SALTS = 16


def lines_of(text: str) -> list[bytes]:
    """The lines with a word, without outer blanks."""
    return [x for x in (line.strip() for line in text.encode().split(b"\n")) if x]


def _low(digest: str) -> int:
    """The first 16 hexadecimal digits, as a signed 64-bit integer."""
    x = int(digest[:16], 16)
    return x - (1 << 64) if x >> 63 else x


def fingerprints(lines: list[bytes]) -> tuple[list[int], list[tuple[str, int]]]:
    """The hash of each line; and the selected shingles, as (hash, number of the line that it begins in)."""
    names = [md5(x).hexdigest() for x in lines]
    units, at = [], []
    for i, (line, name) in enumerate(zip(lines, names)):
        n = max(1, -(-len(line.split()) // UNIT_WORDS))
        units += [f"{name}.{j}" for j in range(n)]
        at += [i] * n
    g = [md5("|".join(units[i : i + NOISE]).encode()).hexdigest()[:16] for i in range(len(units) - NOISE + 1)]
    chosen, last = [], -1
    for i in range(max(1, len(g) - WINDOW + 1) if g else 0):
        _, back = min((g[j], -j) for j in range(i, min(i + WINDOW, len(g))))
        if -back != last:
            last = -back
            chosen.append((g[last], at[last]))
    return [_low(x) for x in names], chosen


def extended(lines: list[int], source: list[int], places: list[tuple[int, int]]) -> set[int]:
    """The lines that the matches at `places`, pairs of line numbers, extend to."""
    gone: set[int] = set()
    done: dict[int, int] = {}  # by diagonal, the end of the last match
    for p, q in sorted(places):
        if p < done.get(p - q, -1) or lines[p] != source[q]:
            continue
        a, b = p, p + 1
        while a > 0 and a - 1 - (p - q) >= 0 and lines[a - 1] == source[a - 1 - (p - q)]:
            a -= 1
        while b < len(lines) and b - (p - q) < len(source) and lines[b] == source[b - (p - q)]:
            b += 1
        done[p - q] = b
        gone.update(range(a, b))
    return gone


_PLACES = "doc long, copy long, lines array<long>, prints array<struct<print:long,line:int>>"


def _place_rows(batches):
    t = pa.list_(pa.struct([("print", pa.int64()), ("line", pa.int32())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            got = [fingerprints(lines_of(x)) for x in part.column(2).to_pylist()]
            prints = [[{"print": _low(g), "line": i} for g, i in y] for _, y in got]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in got], pa.list_(pa.int64())), pa.array(prints, t)], ["doc", "copy", "lines", "prints"])
    B.release()


def _extended_rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            lines, source, places = (part.column(i).to_pylist() for i in (2, 3, 4))
            gone = [sorted(extended(a, b, [(x["p"], x["q"]) for x in c])) for a, b, c in zip(lines, source, places, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gone, pa.list_(pa.int32()))], ["doc", "copy", "gone"])
    B.release()


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"), F.col(f"`{text_col}`").alias("text"))


def repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, copy, gone): the numbers of the lines, lines with words only, that repeat earlier ones; copy is the text's hash."""
    scratch = Scratch(spark)
    base = _documents(docs, id_col, text_col).filter("doc is not null and text is not null")
    places = scratch.cut(base.mapInArrow(_place_rows, _PLACES), "places")
    one = places.select("doc", "copy", F.explode("prints").alias("x")).select(F.col("x.print").alias("print"), "doc", "copy", F.col("x.line").alias("line"))
    here = F.struct("doc", "copy", "line")
    first = one.groupBy("print").agg(F.min("doc").alias("d"), F.count("*").alias("n")).filter("n > 1").select("print")  # what occurs once repeats nothing
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("doc", "copy", "line"), F.lit(SALTS)).cast("int")
    again = scratch.cut(one.withColumn("salt", salt).join(first.withColumn("salt", salts), ["print", "salt"]).drop("salt"), "again")
    source = again.groupBy("print").agg(F.min(here).alias("first")).withColumn("salt", salts)
    pairs = again.withColumn("salt", salt).join(source, ["print", "salt"]).filter(here != F.col("first"))
    pairs = pairs.groupBy("doc", "copy", F.col("first.doc").alias("doc0"), F.col("first.copy").alias("copy0")).agg(F.collect_set(F.struct(F.col("line").alias("p"), F.col("first.line").alias("q"))).alias("places"))
    pairs = scratch.cut(pairs, "pairs")

    once = places.select("doc", "copy", "lines").dropDuplicates(["doc", "copy"])
    later = pairs.join(once, ["doc", "copy"]).withColumn("salt", F.pmod(F.xxhash64("doc", "copy"), F.lit(SALTS)).cast("int"))
    needed = pairs.select(F.col("doc0").alias("doc"), F.col("copy0").alias("copy")).distinct()
    sources = once.join(needed, ["doc", "copy"], "left_semi").select(F.col("doc").alias("doc0"), F.col("copy").alias("copy0"), F.col("lines").alias("source")).withColumn("salt", salts)
    both = later.join(sources, ["doc0", "copy0", "salt"]).select("doc", "copy", "lines", "source", "places")
    gone = both.mapInArrow(_extended_rows, "doc long, copy long, gone array<int>")
    return gone.groupBy("doc", "copy").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def without_lines(text: str, gone: set[int]) -> tuple[str, int]:
    kept, n, blanks, cut = [], -1, [], 0
    last_gone = False
    for line in text.split("\n"):
        if not line.strip(" \t\n\x0b\x0c\r"):
            blanks.append(line)
            continue
        n += 1
        if n in gone:
            if not last_gone:
                kept += blanks
            cut += 1
            last_gone = True
        else:
            kept += blanks
            kept.append(line)
            last_gone = False
        blanks = []
    return "\n".join(kept + blanks), cut


def _clean(batches):
    for batch in batches:
        texts, gone = batch.column(1), batch.column(2)
        out, cut = texts.to_pylist(), np.zeros(len(texts), np.int64)
        for i, g in enumerate(gone.to_pylist()):
            if g and out[i] is not None:
                out[i], cut[i] = without_lines(out[i], set(g))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(cut)], ["row", "text", "cut"])
    B.release()


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cleaned, and the count of lines removed as n_removed_lines."""
    gone = repeated_lines(spark, docs, id_col, text_col)
    rest = [c for c in docs.columns if c not in (text_col, "n_removed_lines")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    keyed = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"), F.col(f"`{text_col}`").alias("text"))
    joined = keyed.join(gone, ["doc", "copy"], "left").select("row", "text", "gone")
    done = joined.mapInArrow(_clean, T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("cut", T.LongType())]))
    cols = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "n_removed_lines"]
    return done.select(*cols, F.col("cut").alias("n_removed_lines"))
