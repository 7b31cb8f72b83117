r"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are lowered (A-Z) and cut into words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.  Each benchmark item
gives its windows of WINDOW consecutive words (an item of fewer words, but not none, gives one window).
Words are written as single characters, by a vocabulary of the benchmark's words; the automaton holds
all windows and reads each document once.  Word positions map back to byte offsets of the text.

The automaton is sent to executors only for items of up to SHARD_BYTES; a larger benchmark is dealt
into shards of that size.  Each is a pass of its own over the documents, whose hits are written before the next shard is
sent and the last one freed: a worker never holds more than one.  Hits are then merged by doc_id and text.  The result is the same.

Null and empty texts have no words, texts of any length are read whole.  Repeated items count once by item_id, items without an id not at all; repeated documents give
repeated rows; rows with a null doc_id are scanned like others; empty tables give no rows or no hits.  Other columns stay as they are; one named hit is replaced.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _bytes as B
from ._scratch import Scratch

WINDOW = 10
SHARD_BYTES = 4 << 20
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_HIT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def _char(i: np.ndarray) -> np.ndarray:
    """Code points for vocabulary indices; 0 is any other word, surrogates are passed over."""
    c = i.astype(np.uint32)
    return np.where(c >= 0xD800, c + 0x800, c).astype("<u4")


class Windows:
    """The windows of some items, and the automaton over them (made once per Python worker)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        per, every = [], []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            _, _, h, _ = B.words(raw, np.array([0, len(raw)]), B.ALNUM)
            per.append((item, h))
            every.append(h)
        self.vocabulary = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        if len(self.vocabulary) > 1_000_000:
            raise ValueError("a shard has more words than code points; lower SHARD_BYTES")
        self.items: list[str] = []
        number: dict[str, int] = {}
        self.windows: dict[str, set[int]] = {}
        for item, h in per:
            s = self.encode(h)
            for a in range(max(1, len(s) - window + 1)) if s else ():
                i = number.setdefault(item, len(number))
                self.windows.setdefault(s[a : a + window], set()).add(i)
        self.items = list(number)
        self._automaton = None

    def encode(self, h: np.ndarray) -> str:
        if not len(self.vocabulary):
            return "\0" * len(h)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return _char(np.where(self.vocabulary[at] == h, at + 1, 0)).tobytes().decode("utf-32-le")

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for w, items in self.windows.items():
                a.add_word(w, (len(w), tuple(items)))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def scan(self, column: pa.Array):
        """(n_words, n_hit, items, spans) for each text of the column."""
        for _, _, buf, off in B.text_slices(column):
            starts, ends, h, counts = B.words(buf, off, B.ALNUM)
            base = np.cumsum(counts) - counts
            # a word outside the vocabulary stands between texts
            gaps = np.insert(h, base[1:] if len(base) > 1 else [], np.uint64(0)) if len(counts) > 1 else h
            hits: dict[int, tuple[list, set]] = {}
            if self.windows:
                first = base + np.arange(len(base))  # of each text in gaps
                for end, (size, items) in self.automaton().iter(self.encode(gaps)):
                    t = int(np.searchsorted(first, end, "right")) - 1
                    while counts[t] == 0:
                        t -= 1
                    got = hits.setdefault(t, ([], set()))
                    e = end - int(first[t]) + 1
                    got[0].append((e - size, e))
                    got[1].update(items)
            for t in range(len(counts)):
                if t not in hits:
                    yield int(counts[t]), 0, [], []
                    continue
                merged: list[list[int]] = []
                for a, b in sorted(hits[t][0]):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                yield int(counts[t]), sum(b - a for a, b in merged), [self.items[i] for i in hits[t][1]], [{"start": a, "end": b} for a, b in merged]


def shards(benchmark: DataFrame, id_col: str, text_col: str, shard_bytes: int):
    """Lists of (item, text), each of at most about shard_bytes; only one is on the driver at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // shard_bytes) if total > shard_bytes else 1
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        yield i, n, [(r.item, r.text) for r in part.collect()]


def _merged(spans: str) -> str:
    """SQL for a list of spans in order, in which those that touch are one."""
    return f"""aggregate(array_sort({spans}), cast(array() as array<struct<start:int,end:int>>), (acc, x) ->
        if(size(acc) > 0 and acc[size(acc) - 1].end >= x.start,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'end', greatest(acc[size(acc) - 1].end, x.end)))),
           concat(acc, array(x))))"""


def scan_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with a struct `hit`: n_words, n_hit, items (sorted), spans (word numbers, end exclusive)."""
    text, passes, scratch = F.col(f"`{text_col}`"), [], None

    def scanner(held):
        @F.pandas_udf(_HIT)
        def scanned(texts):
            import pandas as pd

            rows = list(held.value.scan(pa.array(texts, pa.string())))
            return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

        return scanned

    for i, n, items in shards(benchmark, item_col, item_text_col, shard_bytes):
        held = spark.sparkContext.broadcast(Windows(items))
        if n == 1:
            out = docs.withColumn("hit", scanner(held)(text))
            return out.withColumn("hit", F.expr("struct(hit.n_words, hit.n_hit, array_sort(hit.items) as items, hit.spans)"))
        scratch = scratch or Scratch(spark)
        got = docs.select(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("b"), scanner(held)(text).alias("x"))
        passes.append(scratch.cut(got.filter("x.n_hit > 0").select("i", "t", "b", "x.items", "x.spans").dropDuplicates(["i", "t", "b"]), f"hits-{i}"))
        held.destroy()
    hits = reduce(DataFrame.unionByName, passes).groupBy("i", "t", "b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    hits = hits.select(F.struct("i", "t", "b").alias("k"), "items", F.expr(_merged("spans")).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "hit"]).alias("row"), F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("b")).alias("d"), F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    same = (F.col("d.t") == F.col("k.t")) & F.col("d.i").eqNullSafe(F.col("k.i")) & F.col("d.b").eqNullSafe(F.col("k.b"))
    hit = F.expr("struct(n_words, aggregate(coalesce(spans, array()), 0L, (s, x) -> s + x.end - x.start) as n_hit, coalesce(items, array()) as items, coalesce(spans, array()) as spans)")
    return rows.join(hits, same, "left").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "hit"], hit.alias("hit"))


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    got = scan_documents(spark, docs.select("doc_id", "text"), benchmark)
    return got.select(
        "doc_id", F.col("hit.n_words").alias("n_words"), F.col("hit.n_hit").alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("hit.n_hit") > 0).alias("contaminated"),
    )


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def word_bytes(text: str) -> list[tuple[int, int]]:
    """Byte spans of a text's words: where a span of `hit` lies in the original."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _, _ = B.words(raw, np.array([0, len(raw)]), B.ALNUM)
    return list(zip(starts.tolist(), ends.tolist()))
