r"""N-gram Jaccard join by vertical partitioning.

The global order of shingles (common ones last, each half by 64-bit hash) is cut into fragments.  Two sets
that link (100 * intersection >= percent * union, sizes n and m) differ in at most
D = (n + m) * (100 - percent) / (100 + percent) shingles, so at most D fragments of theirs differ: of the first D + 1
non-empty fragments of each set, taken in order, at least one is the same in both (the first equal one has
at most D unequal ones before it on either side).  Only those are joined, as a prefix filter over fragments; sets
with fewer non-empty fragments take single shingles as fragments too.  Fragments are cut by the size class (octave) of
the larger set, so sets of sizes that can't link don't meet.

The overlap of a pair is counted in each of COUNT_FRAGMENTS wider fragments separately, and the partial
counts are summed per pair.  Groups of near copies are not expanded into pairs: equal sets are one class from the start; the classes of
a bucket have a leader, and each class is counted against one of its leaders, then against one in each other component that they
lie in; then only classes of one bucket that lie in different components still are counted, which no link escapes.
Parity sketches rule pairs out before arrays move: sets that differ in d shingles differ in d bits at most
(a bit for each of SKETCH_BITS ranges of the order, that of the count of shingles in it).

The COMMON most frequent shingles, of those that a chunk of a task's rows holds COMMON_IN_CHUNK times, are the
common ones.  That table only orders the shingles: any order gives the same links, so its fixed size loses nothing.

Nulls and empty texts have no shingles (n_shingles 0) and are a component of their own.  Repeated
rows give repeated rows; a doc_id with several texts links each of them.  A null doc_id links by its
text and is never a component's id unless the component has no other.  Other columns are left out, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import _bytes as B
from ._graph import components
from ._scratch import Scratch

U = np.uint64
WORDS = 3
#: wider fragments in which overlaps are counted
COUNT_FRAGMENTS = 4
SKETCH_BITS = 1024
CHUNK_ROWS = 1 << 18
#: shingles in a chunk among which common ones are looked for, how often they must be there, and how many are kept
COMMON_CHUNK, COMMON_IN_CHUNK, COMMON = 1 << 21, 6, 1 << 18
#: signatures by which a pair of one bucket knows that it also meets in another
LOW_SIGNATURES = 32
#: a class or component id that holds a large share of the rows is dealt to so many keys where it is joined
SALTS = 16


def differences(n: np.ndarray, octave: np.ndarray, percent: int) -> np.ndarray:
    """The most shingles in which sets of n shingles differ from linked ones, none of which is over the octave."""
    m = np.minimum(100 * n // percent, (np.int64(2) << octave) - 1)
    return (n + np.maximum(n, m)) * (100 - percent) // (100 + percent)


def fragment_count(octave: int, percent: int) -> int:
    """Enough fragments that more are non-empty than can differ, for nearly all sets of the octave."""
    return 1 + -(-13 * ((2 << octave) * (100 - percent) // percent) // 10)


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int = WORDS):
    """Sorted distinct shingle hashes of each text of a slice, one after the other, and their counts."""
    _, _, h, counts = B.words(buf, off, B.BLANK_SEPARATED)
    every, parts, n = B.grams(h, words), [], np.zeros(len(counts), np.int64)
    a = 0
    for i, c in enumerate(counts):
        if c >= words:
            x = np.sort(every[a : a + c - words + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            x = B.grams(h[a : a + c], int(c)) if c else h[:0]
        parts.append(x)
        n[i] = len(x)
        a += c
    return (np.concatenate(parts) if parts else np.zeros(0, U)), n


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of each text's part of x; 0 for empty ones."""
    out = np.zeros(len(n), U)
    full = n > 0
    if full.any():
        out[full] = np.add.reduceat(x, (np.cumsum(n) - n)[full])
    return out


def class_keys(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    return B.mix(_sums(B.mix(s ^ U(0xA5A5F00D12345677)), n) + n.astype(U)).view(np.int64)


def signatures(s: np.ndarray, n: np.ndarray, percent: int = 90, common: np.ndarray | None = None):
    """(text, signature) for the first fragments of each text, in each octave where it may meet others."""
    texts, sigs = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    late = np.zeros(len(s), bool)
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        late = common[at] == s
    begin = np.cumsum(n) - n
    own = np.frexp(np.maximum(n, 1).astype(np.float64))[1].astype(np.int64) - 1
    top = np.frexp(np.maximum(100 * n // percent, 1).astype(np.float64))[1].astype(np.int64) - 1

    def emit(which: np.ndarray, octave: int, single: bool):
        """The fragments of the texts `which`; with `single`, each shingle is one."""
        size, most = n[which], differences(n[which], np.int64(octave), percent)
        doc = np.repeat(np.arange(len(which)), size)
        take = np.repeat(begin[which] - (np.cumsum(size) - size), size) + np.arange(len(doc))
        x, c = s[take], late[take]
        if single:
            frag = c.astype(np.int64)  # order within: by hash, which s has already
        else:
            f = fragment_count(octave, percent)
            frag = (((x >> U(32)) * U(f)) >> U(32)).astype(np.int64) + f * c
        if c.any():
            by = np.argsort((doc << 40) + frag, kind="stable")
            x, doc, frag = x[by], doc[by], frag[by]
        first = np.ones(len(x), bool)
        if not single:
            first[1:] = (frag[1:] != frag[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        of = doc[at]
        held = np.bincount(of, minlength=len(which))  # non-empty fragments
        rank = np.arange(len(at)) - np.repeat(np.cumsum(held) - held, held)
        tag = np.full(len(at), (octave * 2 + single + 1) * 0x100000001B3, U) + (U(0) if single else frag[at].astype(U) * U(0x9E3779B97F4A7C15))
        sig = B.mix(np.add.reduceat(B.mix(x ^ U(0x0DDB1A5E5BAD5EED)), at) + B.mix(tag)) if len(at) else np.zeros(0, U)
        keep = rank <= most[of]
        texts.append(which[of[keep]])
        sigs.append(sig[keep])
        short = (held <= most) & (most > 0)
        if not single and short.any():
            emit(which[short], octave, True)

    for octave in range(int(top.max()) + 1 if len(n) else 0):
        which = np.flatnonzero((n > 0) & (own <= octave) & (octave <= top))
        which = which[differences(n[which], np.int64(octave), percent) > 0]
        if len(which):
            emit(which, octave, False)
    return np.concatenate(texts), np.concatenate(sigs).view(np.int64)


def _class_rows(batches, words):
    """Of each row doc_id, n_shingles and class key; beside them, with n_shingles < 0, shingles (as key) that
    are common in a chunk, and minus their count."""
    held, size = [], 0

    def frequent():
        token, times = np.unique(np.concatenate(held), return_counts=True)
        at = times >= COMMON_IN_CHUNK
        token, times = token[at].view(np.int64), times[at]
        return pa.RecordBatch.from_arrays([pa.nulls(len(token), pa.int64()), pa.array(-times), pa.array(token)], ["doc_id", "n_shingles", "key"])

    for batch in batches:
        for i, j, buf, off in B.text_slices(batch.column(1)):
            s, n = shingle_sets(buf, off, words)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(class_keys(s, n))], ["doc_id", "n_shingles", "key"])
            held.append(s)
            size += len(s)
            if size >= COMMON_CHUNK:
                yield frequent()
                held, size = [], 0
    if held:
        yield frequent()
    del held
    B.release()


def _signature_rows(batches, words, percent, common):
    """Within a chunk of a task's rows, a class is emitted once, and of a signature's classes one
    leads: what meets in a hot bucket later is a row per chunk, not one per document."""
    held, size, seen = [], 0, set()

    def flush():
        sig, key = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((key, sig))
        first = np.ones(len(sig), bool)
        first[1:] = sig[by][1:] != sig[by][:-1]
        run = np.empty(len(sig), np.int64)
        run[by] = np.cumsum(first) - 1
        lead = key[by][np.flatnonzero(first)][run]
        alone = np.bincount(run)[run] == 1
        follows = ~alone & (lead != key)
        # a follower needs no bucket: it is dealt by a hash of its own, and carries its signature beside it
        bucket = np.where(follows, B.mix(sig.view(U) ^ B.mix(key.view(U))).view(np.int64), sig)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(sig, mask=~follows), pa.array(key), pa.array(lead, mask=alone)], ["bucket", "own", "key", "lead"])

    for batch in batches:
        for _, _, buf, off in B.text_slices(batch.column(0)):
            s, n = shingle_sets(buf, off, words)
            keys = class_keys(s, n)
            fresh = np.zeros(len(n), bool)
            for i, k in enumerate(keys.tolist()):
                if n[i] and k not in seen:
                    fresh[i] = True
                    seen.add(k)
            if len(seen) > 100_000:
                seen.clear()  # a class emitted twice is only work done twice
            s, n, keys = s[np.repeat(fresh, n)], n[fresh], keys[fresh]
            text, sig = signatures(s, n, percent, common.value)
            if len(sig):
                by = np.argsort(text, kind="stable")  # a class's rows together compress well
                text, sig = text[by], sig[by]
                held.append((sig, keys[text]))
                size += len(sig)
            if size >= CHUNK_ROWS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()
    del held, seen
    B.release()


def _keyed_texts(batches, words):
    """Each text with its class key."""
    for batch in batches:
        for i, j, buf, off in B.text_slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(class_keys(*shingle_sets(buf, off, words))), batch.column(0).slice(i, j - i)], ["key", "text"])
    B.release()


def parity_sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> U(64 - 10)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _segment_rows(batches, words):
    """The segments of texts whose class key is among `keys`."""
    cuts_at = [U(f * (1 << 32) // COUNT_FRAGMENTS) for f in range(1, COUNT_FRAGMENTS)]
    for batch in batches:
        wanted = batch.column(1)
        for i0, _, buf, off in B.text_slices(batch.column(0)):
            s, n = shingle_sets(buf, off, words)
            keys, a = class_keys(s, n), 0
            key, frag, seg, sketch = [], [], [], []
            for i, c in enumerate(n):
                if c and int(keys[i]) in wanted[i0 + i].as_py():
                    cuts = np.searchsorted(s[a : a + c] >> U(32), cuts_at)
                    for f, x in enumerate(np.split(s[a : a + c], cuts)):
                        key.append(keys[i])
                        frag.append(f)
                        seg.append(x.view(np.int64))
                        sketch.append(None if f else parity_sketch(s[a : a + c]))
                a += c
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(frag, pa.int32()), pa.array(seg, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["key", "frag", "seg", "sketch"])
    B.release()


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs(a, b) with the size of the intersection: counted in each fragment, summed per pair.

    Only the segments of b travel to those of a; both end in the task that counts them, and counts alone
    go on.  A segment that is there twice counts once.
    """
    right = segments.select(F.col("key").alias("b"), "frag", F.col("seg").alias("sb"))
    left = segments.select(F.col("key").alias("a"), "frag", F.col("seg").alias("sa"))
    each = pairs.select("a", "b").join(right, "b").join(left, ["a", "frag"])
    part = [F.max(F.when(F.col("frag") == f, F.size(F.array_intersect("sa", "sb")))).alias(f"part{f}") for f in range(COUNT_FRAGMENTS)]
    return each.groupBy("a", "b").agg(*part).select("a", "b", F.expr(" + ".join(f"part{f}" for f in range(COUNT_FRAGMENTS))).alias("common"))


def common_shingles(classes: DataFrame) -> np.ndarray:
    """The COMMON most frequent of the shingles that some chunk found common, sorted: a table of fixed size."""
    top = classes.filter("n_shingles < 0").groupBy("key").agg(F.sum("n_shingles").alias("m")).orderBy("m", "key").limit(COMMON).select("key")
    got = top.toArrow().column("key").to_numpy()
    return np.sort(got.astype(np.int64).view(U))


def link_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 90) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    scratch = Scratch(spark)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = scratch.cut(base.mapInArrow(partial(_class_rows, words=words), "doc_id long, n_shingles long, key long"), "classes")
    classes = found.filter("n_shingles >= 0")
    sizes = scratch.cut(classes.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "sizes")
    common = spark.sparkContext.broadcast(common_shingles(found))

    rows = base.select("text").mapInArrow(partial(_signature_rows, words=words, percent=percent, common=common), "bucket long, own long, key long, lead long")
    by = Window.partitionBy("bucket")
    follows = F.col("own").isNotNull()
    shared = rows.select("bucket", "own", "key", "lead", F.min("key").over(by).alias("low"), F.max("key").over(by).alias("high"))
    shared = shared.filter("lead is not null or low <> high").select(F.coalesce("own", "bucket").alias("sig"), "key", F.when(follows, F.col("lead")).otherwise(F.col("low")).alias("low"))
    shared = scratch.cut(shared, "shared")

    wanted = sizes.join(shared.select("key").distinct(), "key", "left_semi").select("key", F.col("doc_id").alias("first"))
    lists = wanted.filter("first is not null").groupBy("first").agg(F.collect_list("key").alias("keys"))  # the texts of one doc_id
    texts = base.join(lists, F.col("doc_id") == F.col("first")).select("text", "keys")
    # classes of rows without doc_id alone go by their key: a text of each, found within the tasks first
    nameless = base.filter("doc_id is null").select("text").mapInArrow(partial(_keyed_texts, words=words), "key long, text string").dropDuplicates(["key"])
    texts = texts.unionByName(nameless.join(wanted.filter("first is null"), "key").select("text", F.array("key").alias("keys")))
    segments = scratch.cut(texts.mapInArrow(partial(_segment_rows, words=words), "key long, frag int, seg array<long>, sketch array<long>"), "segments")
    sketches = scratch.cut(segments.filter("frag = 0").select("key", "sketch").dropDuplicates(["key"]).join(sizes.select("key", "n"), "key"), "sketches")
    differing = "+".join(f"bit_count(x.sketch[{i}] ^ y.sketch[{i}])" for i in range(SKETCH_BITS // 64))
    possible = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {differing} <= ((x.n + y.n) * {100 - percent}) div {100 + percent}"

    sides = [sketches.select(F.col("key").alias(k), F.struct("sketch", "n").alias(v)) for k, v in (("a", "x"), ("b", "y"))]

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Those of pairs(key, low) that link, by sketches first, then by overlaps."""
        pairs = pairs.select(F.least("key", "low").alias("a"), F.greatest("key", "low").alias("b")).distinct()
        near = pairs.join(sides[0], "a").join(sides[1], "b").filter(possible).select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        near = scratch.cut(near, f"near-{name}")
        got = overlaps(near, segments).join(near, ["a", "b"])
        return scratch.cut(got.filter(f"100 * common >= {percent} * (na + nb - common)").select("a", "b"), f"links-{name}")

    def placed(rows: DataFrame, part: DataFrame, key: str, c: str) -> DataFrame:
        node, component = F.col("node").alias(f"__{key}"), F.col("component").alias(f"__{c}")
        rows = rows.join(part.select(node, component), F.col(key) == F.col(f"__{key}"), "left")
        return rows.withColumn(c, F.coalesce(f"__{c}", key)).drop(f"__{key}", f"__{c}")

    # each class meets one leader of its buckets; then one in each other component that its leaders lie in
    links = linked(shared.filter("key <> low").groupBy("key").agg(F.min("low").alias("low")), "1")
    part = components(links, scratch, "parts-1")
    apart = placed(placed(shared.select("key", "low").filter("key <> low").distinct(), part, "key", "c"), part, "low", "d").filter("c <> d")
    more = linked(apart.groupBy("key", "d").agg(F.min("low").alias("low")), "2")
    if not more.isEmpty():
        links = links.unionByName(more)
        part = components(links, scratch, "parts-2")

    # at last classes of one bucket that lie in different components still
    at = scratch.cut(placed(shared.select("sig", "key"), part, "key", "c").distinct(), "at")
    mixed = at.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("sig")
    at = scratch.cut(at.join(mixed, "sig", "left_semi"), "mixed")
    lows = at.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, LOW_SIGNATURES).alias("lows"))
    at = scratch.cut(at.join(lows, "key").join(sketches, "key").select("sig", "key", "n", "c", "sketch", "lows"), "compared")
    # a pair that shares many signatures meets at the least of them; where no low one is shared it may meet at several
    once = "coalesce(array_min(array_intersect(x.lows, y.lows)) >= x.sig, true)"
    x, y = at.alias("x"), at.alias("y")
    across = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & F.expr(possible) & F.expr(once))
    more = linked(across.select(F.col("x.key").alias("key"), F.col("y.key").alias("low")), "3")
    if not more.isEmpty():
        part = components(links.unionByName(more), scratch, "parts-3")

    # the least doc_id of each component, then of each class; a hot component or class is dealt to SALTS keys
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    labels = sizes.join(part, sizes.key == part.node, "left").select("key", "doc_id", F.coalesce("component", "key").alias("c"))
    least = labels.groupBy("c").agg(F.min("doc_id").alias("least")).withColumn("salt", salts)
    labels = labels.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(least, ["c", "salt"]).select("key", "least")
    labels = scratch.cut(labels, "labels")
    for name in ("shared", "segments", "sketches", "near-1", "near-2", "near-3", "links-1", "links-2", "links-3", "at", "mixed", "compared", "sizes"):
        scratch.drop(name)  # only classes and labels are read from here on
    left = classes.withColumn("salt", F.when(F.col("n_shingles") > 0, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    right = labels.withColumn("salt", salts)
    out = left.join(right, ["key", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
