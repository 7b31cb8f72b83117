r"""Phrase collocations from position bitmaps, in the manner of SPAM.

A-Z are lowered; pieces end at [.,;:!?\x0A-\x0D], words are [^\x20\x09]+ within them.  Everything is counted per language (null: und).

Shards: each task cuts its texts, language by language, into shards of about SHARD words.  A shard is a sequence of positions with an empty
position between pieces.  In it each frequent word has a bitmap of its positions, of which only the non-zero bytes are held (word, block, bits).  To
extend phrases by a word their bitmaps are shifted by one position, carrying into the next block, and ANDed with the words' bitmaps of the same
blocks; the popcount of what is left is how often the longer phrase occurs.  As no word stands at the empty positions, nothing crosses a piece.

Rounds: words are counted first.  Then each shard extends its frequent words by one, and counts of pairs are summed over shards.  With the
verdicts on pairs each shard searches depth-first, a batch of first words at a time down to LONGEST words, extending a phrase only by words that
make a frequent pair with its last one; these counts are summed as well.  Counts of phrases travel packed, a row per shard and bucket of phrases, and are summed
bucket by bucket; each shard gets back which of its own words and pairs are frequent.  Nothing that grows with the corpus is broadcast or gathered.  Words have dense numbers, so that keys are exact; within one shard a word is known
by a 64-bit hash.

Counts, sums and the score's products are exact (integers, decimals of 38 digits).  A very long text is read whole, as one or more whole
pieces; repeated rows count each time; null and empty texts have no words.  Ties are broken as stated at `collocations`.  An empty
table gives no rows.  Only the language and the text are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import _bytes
from ._scratch import Scratch

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: positions of a shard, and bytes of bitmaps that are extended at a time
SHARD, BATCH = 1 << 21, 1 << 17
#: words of the corpus for each bucket in which counts of phrases are summed
BUCKET = 1 << 21
#: bytes of text that are cut into words at a time
SLICE = 1 << 20
#: parts a language's rows are dealt to before their best are merged
SALTS = 32
_PIECE = frozenset(b".,;:!?\n\x0b\x0c\r")
_WORDS = _bytes._lut(lambda b: b not in (32, 9) and b not in _PIECE)
_ENDS = np.array([b in _PIECE for b in range(256)], np.int32)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_INDEX = "shard long, lang string, no int, word string, n long, seq binary"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("no", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("seq", pa.binary())])


def _spelled(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at these spans, lowered."""
    size = ends - starts
    off = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(starts - off[:-1], size) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(_LOWER[buf[at]])])


class _Shard:
    """Words of one language as they come, each slice with its own vocabulary until the shard is packed."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, buf: np.ndarray, off: np.ndarray) -> None:
        starts, ends, h, counts = _bytes.words(buf, off, _WORDS)
        if not len(starts):
            return
        piece = np.cumsum(_ENDS[buf])[starts]
        new = np.ones(len(starts), bool)
        new[1:] = piece[1:] != piece[:-1]
        new[np.cumsum(counts)[:-1][np.cumsum(counts)[:-1] < len(starts)]] = True  # a text begins
        u, first, no = np.unique(h, return_index=True, return_inverse=True)
        self.parts.append((u, _spelled(buf, starts[first], ends[first]), no.astype(np.int32), new))
        self.size += len(new) + int(new.sum())

    def pack(self, shard: int, lang: str) -> Iterator[pa.RecordBatch]:
        """A row per word, then one of the sequence: 0 where a piece ends, else a word's number + 1."""
        u, first, again = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
        spelled = pa.concat_arrays([p[1] for p in self.parts]).take(pa.array(first)).cast(pa.string())
        seq, at, base = np.zeros(self.size + 1, np.int32), 0, 0
        while self.parts:
            own, _, no, new = self.parts.pop(0)
            pos = np.cumsum(new, dtype=np.int32) + np.arange(len(new), dtype=np.int32)
            seq[at + pos] = again[base : base + len(own)][no] + 1
            at, base = at + int(pos[-1]) + 1, base + len(own)
        # frequent words get small numbers, which compress
        n = np.bincount(seq, minlength=len(u) + 1)[1:]
        order = np.argsort(-n, kind="stable")
        number = np.zeros(len(u) + 1, np.int32)
        number[order + 1] = np.arange(1, len(u) + 1)
        np.take(number, seq, out=seq)
        n, spelled = n[order], spelled.take(pa.array(order))
        for i in range(0, len(u), 1 << 16):
            part = slice(i, i + (1 << 16))
            m = len(n[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard)), pa.array([lang] * m, pa.string()), pa.array(np.arange(i, i + m), pa.int32()), spelled[part], pa.array(n[part]), pa.nulls(m, pa.binary())], schema=_INDEX_ARROW)
        packed = len(seq).to_bytes(8, "little") + _planes(seq)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([lang]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([len(seq)]), pa.array([packed], pa.binary())], schema=_INDEX_ARROW)


def _unpack(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return _planes_back(packed[8:], size, np.int32)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: first bytes, second bytes and so on, compressed."""
    return pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _planes_back(packed: bytes, size: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    planes = pa.decompress(packed, width * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size).T).view(kind).ravel()


def _sharded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, open_ = TaskContext.get().partitionId() << 24, 0, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                for lang in pc.unique(batch.column(0)).to_pylist():
                    texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
                    for _, _, buf, off in _bytes.text_slices(texts, SLICE):
                        shard = open_.setdefault(lang, _Shard())
                        shard.add(buf, off)
                        if shard.size >= size:
                            yield from open_.pop(lang).pack(base + made, lang)
                            made += 1
        for lang in list(open_):
            if (shard := open_.pop(lang)).size:
                yield from shard.pack(base + made, lang)
                made += 1
        _bytes.release()

    return run


class Bitmaps:
    """The positions of a shard's frequent words.  ids: their global numbers, ascending; word i of the shard is ids[i]."""

    def __init__(self, seq: np.ndarray, no: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.n = ids[order], len(ids)
        local = np.full(max(int(seq.max(initial=0)), int(no.max(initial=-1)) + 1) + 1, -1, np.int32)
        local[no[order] + 1] = np.arange(self.n)
        word = local[seq]
        pos = np.flatnonzero(word >= 0)
        word, block = word[pos], (pos >> 3).astype(np.int32)
        bit = np.left_shift(1, pos & 7).astype(np.uint8)
        order = np.argsort(word, kind="stable")
        word, block, bit = word[order], block[order], bit[order]
        head = np.ones(len(word), bool)
        head[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(head)
        self.word, self.block = word[at], block[at]
        self.bits = np.bitwise_or.reduceat(bit, at) if len(at) else bit
        # the same bitmaps by block, for the AND with all words at once
        order = np.argsort(self.block, kind="stable")
        self.by_word, self.by_bits = self.word[order], self.bits[order]
        self.start = np.searchsorted(self.block[order], np.arange((len(seq) >> 3) + 4))

    def roots(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, block, bits) of a batch of words after another."""
        first = np.searchsorted(self.word, np.arange(self.n + 1))
        w = 0
        while w < self.n:
            end = max(w + 1, int(np.searchsorted(first, first[w] + BATCH, "right")) - 1)
            part = slice(first[w], first[end])
            yield self.word[part], self.block[part], self.bits[part]
            w = end

    def step(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """Shift by a position and AND with every word: (node, word, block, bits) of what is left."""
        wide = bits.astype(np.uint16) << 1
        low, over = (wide & 0xFF).astype(np.uint8), wide > 0xFF
        stay = low != 0
        node = np.concatenate((node[stay], node[over]))
        block = np.concatenate((block[stay], block[over] + 1))
        low = np.concatenate((low[stay], np.ones(int(over.sum()), np.uint8)))
        first = self.start[block]
        many = self.start[block + 1] - first
        src = np.repeat(np.arange(len(block)), many)
        at = np.arange(len(src)) + np.repeat(first - (np.cumsum(many) - many), many)
        both = self.by_bits[at] & low[src]
        hit = np.flatnonzero(both)
        src = src[hit]
        return node[src], self.by_word[at[hit]], block[src], both[hit]


def _grouped(key: np.ndarray, bits: np.ndarray):
    """(order, key of each group, popcount of each, group of each row in order)"""
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(head)
    n = np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return order, key[at], n, np.cumsum(head) - 1


def count_pairs(maps: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, n), a row of two word numbers per pair."""
    for word, block, bits in maps.roots():
        node, child, _, both = maps.step(word, block, bits)
        _, key, n, _ = _grouped(node.astype(np.int64) * maps.n + child, both)
        if len(key):
            yield maps.ids[np.column_stack((key // maps.n, key % maps.n))].astype(np.int32), n


def count_longer(maps: Bitmaps, pairs: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, n), a row of word numbers per phrase of three words or more all of whose pairs are in pairs; depth-first by batches of first words."""
    known = np.sort(np.searchsorted(maps.ids, pairs[:, 0]) * maps.n + np.searchsorted(maps.ids, pairs[:, 1]))

    def allowed(last: np.ndarray, child: np.ndarray) -> np.ndarray:
        key = last.astype(np.int64) * maps.n + child
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        return known[at] == key

    for word, block, bits in maps.roots() if len(known) else ():
        phrases, node = np.arange(maps.n)[:, None], word
        for depth in range(2, longest + 1):
            node, child, block, bits = maps.step(node, block, bits)
            ok = allowed(phrases[node, -1], child)
            node, child, block, bits = node[ok], child[ok], block[ok], bits[ok]
            if not len(node):
                break
            order, key, n, group = _grouped(node.astype(np.int64) * maps.n + child, bits)
            phrases = np.column_stack((phrases[key // maps.n], key % maps.n))
            node, block, bits = group, block[order], bits[order]
            if depth > 2:
                yield maps.ids[phrases].astype(np.int32), n


def _maps(seqs: pa.Table, told: pa.Table) -> Bitmaps | None:
    words = told.filter(pc.is_valid(told["no"]))
    if not seqs.num_rows or not words.num_rows:
        return None
    return Bitmaps(_unpack(seqs["seq"][0].as_py()), words["no"].to_numpy(), words["value"].to_numpy())


# Counts travel packed: a row for each shard, number of words and bucket, with the phrases in order.  Their columns are the words' numbers.
_COUNTS = "shard long, bucket int, width int, size long, words binary, ns binary"


def _bucketed(shard: int, words: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of _COUNTS of phrases of one width."""
    h = np.zeros(len(words), np.uint64)
    for column in words.T:
        h = _bytes.mix(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1))
    bucket = (h % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((*words.T[::-1], bucket))
    words, n, bucket = words[order], n[order], bucket[order]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(n)] if len(n) else []
    return [(shard, int(bucket[i]), words.shape[1], j - i, _planes(np.ascontiguousarray(words[i:j].T.ravel(), np.int32)), _planes(n[i:j].astype(np.uint32))) for i, j in zip(cuts, cuts[1:])]


def _counts_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["shard", "bucket", "width", "size", "words", "ns"])


def _words_of(packed: bytes, width: int, size: int) -> np.ndarray:
    return _planes_back(packed, width * size, np.int32).reshape(width, size).T


def _pairs_of(buckets: int):
    def run(seqs: pa.Table, told: pa.Table) -> pa.Table:
        maps, rows = _maps(seqs, told), []
        got = list(count_pairs(maps)) if maps else []
        if got:
            words = np.concatenate([w for w, _ in got])
            rows = _bucketed(seqs["shard"][0].as_py(), words, np.concatenate([n for _, n in got]), buckets)
        out = _counts_table(rows)
        _bytes.release()
        return out

    return run


def _longer_of(longest: int, buckets: int):
    def run(seqs: pa.Table, told: pa.Table) -> pa.Table:
        maps, rows = _maps(seqs, told), []
        known = [_words_of(w, 2, size) for w, size in zip(told["words"].to_pylist(), told["size"].to_pylist()) if w is not None]
        by_width: dict[int, list] = {}
        for words, n in count_longer(maps, np.concatenate(known), longest) if maps and known else ():
            by_width.setdefault(words.shape[1], []).append((words, n))
        while by_width:
            _, parts = by_width.popitem()
            rows += _bucketed(seqs["shard"][0].as_py(), np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts]), buckets)
        out = _counts_table(rows)
        _bytes.release()
        return out

    return run


def _summed(min_count: int, back: bool):
    """Sums a bucket's counts over the shards.  The frequent phrases with their sums, as of shard -1; with back also each shard's own."""

    def run(table: pa.Table) -> pa.Table:
        width = table["width"][0].as_py()
        sizes, shards = table["size"].to_numpy(), table["shard"].to_numpy()
        words = np.concatenate([_words_of(w, width, s) for w, s in zip(table["words"].to_pylist(), sizes.tolist())])
        n = np.concatenate([_planes_back(x, s, np.uint32) for x, s in zip(table["ns"].to_pylist(), sizes.tolist())])
        order = np.lexsort(words.T[::-1])
        words = words[order]
        head = np.ones(len(words), bool)
        head[1:] = (words[1:] != words[:-1]).any(axis=1)
        at = np.flatnonzero(head)
        total = np.add.reduceat(n[order].astype(np.int64), at)
        good = total >= min_count
        rows = [(-1, int(table["bucket"][0].as_py()), width, int(good.sum()), _planes(np.ascontiguousarray(words[at[good]].T.ravel())), _planes(total[good]))]
        if back:
            of = np.repeat(np.arange(len(shards)), sizes)[order]
            keep = good[np.cumsum(head) - 1]
            of, words = of[keep], words[keep]
            by = np.argsort(of, kind="stable")
            of, words = of[by], words[by]
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
            rows += [(int(shards[of[i]]), 0, width, j - i, _planes(np.ascontiguousarray(words[i:j].T.ravel())), None) for i, j in zip(cuts, cuts[1:])]
        out = _counts_table(rows)
        _bytes.release()
        return out

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, f) rows of packed sums: a phrase is its words' numbers, 4 bytes each."""
    for batch in batches:
        for width, size, words, ns in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size:
                off = np.arange(0, 4 * width * (size + 1), 4 * width, dtype=np.int32)
                keys = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(_words_of(words, width, size)).astype(">i4").tobytes())])
                yield pa.RecordBatch.from_arrays([keys, pa.array(_planes_back(ns, size, np.int64))], ["phrase", "f"])


def _known(spelled: DataFrame, min_count: int, scratch: Scratch) -> DataFrame:
    """shard, no, lang, word, f and id of the shards' frequent words; id is dense: a word's rank in its part, the parts interleaved."""
    d = spelled.withColumn("f", F.sum("n").over(Window.partitionBy("lang", "word"))).filter(F.col("f") >= min_count)
    d = scratch.cut(d.select("shard", "no", "lang", "word", "f", F.spark_partition_id().alias("part")), "frequent")
    parts, = d.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()
    d = d.withColumn("id", (F.dense_rank().over(Window.partitionBy("part").orderBy("lang", "word")) - 1).cast("long") * parts + F.col("part"))
    d = scratch.cut(d.drop("part"), "known")
    if (d.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise ValueError("too many frequent words: raise the least count")
    scratch.drop("frequent")
    return d


def phrase_counts(spark: SparkSession, docs: DataFrame, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """words (id, lang, word, f, n) and phrases (phrase, f): all of 1 to `longest` words that occur min_count times or more; a phrase is its words' numbers, 4 bytes each, n a language's words."""
    read = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    index = scratch.cut(read.mapInArrow(_sharded(shard), _INDEX), "shards")
    spelled, seqs = index.filter("word is not null"), index.filter("word is null").select("shard", "seq")
    totals = spelled.groupBy("lang").agg(F.sum("n").alias("n"))
    known = _known(spelled, min_count, scratch)
    words = scratch.cut(known.select("id", "lang", "word", "f").distinct().join(totals, "lang"), "words")
    told = known.select("shard", "no", F.col("id").alias("value"))

    # as many buckets as leave each some millions of counts at most
    buckets = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET
    pairs = seqs.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_pairs_of(buckets), _COUNTS)
    pairs = scratch.cut(pairs.groupBy("bucket").applyInArrow(_summed(min_count, True), _COUNTS), "pairs")

    nothing = F.lit(None)
    both = told.withColumns({"size": nothing.cast("long"), "words": nothing.cast("binary")})
    both = both.unionByName(pairs.filter("shard >= 0").select("shard", nothing.cast("int").alias("no"), nothing.cast("long").alias("value"), "size", "words"))
    longer = seqs.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(_longer_of(longest, buckets), _COUNTS)
    longer = longer.groupBy("width", "bucket").applyInArrow(_summed(min_count, False), _COUNTS)
    several = pairs.filter("shard < 0").unionByName(longer).select("width", "size", "words", "ns").mapInArrow(_spread, "phrase binary, f long")
    one = words.select(F.expr("unhex(lpad(hex(id), 8, '0'))").alias("phrase"), "f")
    return words, scratch.cut(one.unionByName(several), "phrases")


def _best(rows: DataFrame, order: list, top: int) -> DataFrame:
    """The first `top` rows of each language, with rank: parts of a language first, then what is left of them."""
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    some = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(spark: SparkSession, docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, percent: int = 100, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words.

    a is how often the phrase occurs, l and r its two parts at the cut with the least score floor(1000 * a * n / (l * r)), the first
    of equal ones.  A phrase within a longer one that occurs `percent` of a or more is dropped.  Ranked by score, a, then the phrase's bytes.
    """
    scratch = Scratch(spark)
    words, phrases = phrase_counts(spark, docs, scratch, lang_col, text_col, min_count, longest, shard)
    several = phrases.filter("octet_length(phrase) > 4")
    cuts = several.select("phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, octet_length(phrase) div 4 - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring(phrase, 1, 4 * k)"), "right": F.expr("substring(phrase, 4 * k + 1)")})
    # a word may begin or end a great part of all phrases: parts' counts are repeated for four keys
    deal = lambda c: F.pmod(F.xxhash64("phrase"), F.lit(4)).cast("int").alias(c)
    parts = phrases.select(F.col("phrase").alias("part"), "f", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("salt"))
    cuts = cuts.withColumn("salt", deal("salt"))
    cuts = cuts.join(parts.select(F.col("part").alias("left"), "salt", F.col("f").alias("l")), ["left", "salt"])
    cuts = cuts.join(parts.select(F.col("part").alias("right"), "salt", F.col("f").alias("r")), ["right", "salt"])
    cuts = cuts.groupBy("phrase", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    inside = several.filter("octet_length(phrase) > 8").select("f", F.explode(F.expr("array(substring(phrase, 1, octet_length(phrase) - 4), substring(phrase, 5))")).alias("phrase"))
    inside = inside.groupBy("phrase").agg(F.max("f").alias("longer"))
    # a longer phrase that holds this one occurs no more often than the one that is a word longer
    left = cuts.join(inside, "phrase", "left").filter(f"longer is null or 100 * longer < {percent} * a")
    first = left.withColumn("id", F.conv(F.hex(F.expr("substring(phrase, 1, 4)")), 16, 10).cast("long")).join(words.select("id", "lang", "n"), "id")
    score = "(cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0))) div (cast(c.l as decimal(19,0)) * cast(c.r as decimal(18,0)))"
    scored = first.select("lang", "phrase", "a", "n", F.expr(f"array_min(transform(cuts, c -> named_struct('score', {score}, 'k', c.k, 'l', c.l, 'r', c.r)))").alias("cut"))
    scored = scratch.cut(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "scored")

    # the last row's score and count, with all that tie, before words are spelled out
    falling = [F.desc("score"), F.desc("a")]
    last = _best(scored, falling, top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    near = scored.join(last, "lang").filter("score > least.score or (score = least.score and a >= least.a)").drop("least")
    each = near.select("phrase", F.posexplode(F.expr("transform(sequence(0, octet_length(phrase) div 4 - 1), i -> cast(conv(hex(substring(phrase, 4 * i + 1, 4)), 16, 10) as bigint))")).alias("i", "id"))
    texts = each.join(words.select("id", "word"), "id").groupBy("phrase").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])).alias("text"))
    spelled = near.join(texts, "phrase").drop("phrase").withColumnRenamed("text", "phrase")
    return _best(spelled, [*falling, F.asc("phrase")], top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
