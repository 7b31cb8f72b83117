"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import phrases


def plain_words(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            yield "und" if lang is None else lang, re.findall(r"[^\x20\x09]+", piece)


def plain(rows, min_count, top, longest=5):
    n, f = Counter(), Counter()
    for lang, w in plain_words(rows):
        n[lang] += len(w)
        f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang, p] = (-score, -a, " ".join(p).encode(), k)
    inside = {(lang, p[i : i + m]) for (lang, p) in found for m in range(2, len(p)) for i in range(len(p) - m + 1) if f[lang, p[i : i + m]] == f[lang, p]}
    out = []
    for lang in n:
        best = sorted((v, p) for (x, p), v in found.items() if x == lang and (x, p) not in inside)[:top]
        out += [(lang, i, " ".join(p), -a, f[lang, p[:k]], f[lang, p[k:]], n[lang], -score) for i, ((score, a, _, k), p) in enumerate(best, 1)]
    return sorted(out)


def mined(spark, rows, min_count=3, top=50, **how):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(spark, docs, min_count=min_count, top=top, **how).collect())


def made(seed, n=300, vocabulary=12):
    r = random.Random(seed)
    word = lambda: r.choice(["New", "york", "é", "the", "of", "x\x1cy", "ÀB", "q-1"] + [f"w{int(r.expovariate(0.3))}" for _ in range(vocabulary)])
    gap = lambda: r.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", " ; ", "\r\n"])
    return [(r.choice(["en"] * 5 + ["fr", None, "und", ""]), "".join(r.choice([word, word, lambda: "in New York City"])() + gap() for _ in range(r.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("seed,shard,batch", [(1, 1 << 22, 1 << 18), (2, 300, 1 << 18), (3, 5000, 7)])
def test_phrases_equal_plain_counting(spark, monkeypatch, seed, shard, batch):
    """However texts are cut into shards, and first words into batches."""
    monkeypatch.setattr(phrases, "BATCH", batch)
    rows = made(seed) + [("en", None), ("fr", ""), (None, " .,; \n")]
    want = plain(rows, 3, 50)
    assert len(want) > 100 and max(len(x[2].split()) for x in want) >= 4
    assert mined(spark, rows, shard=shard) == want


def test_phrases_of_repeated_rows_one_long_text_and_a_common_word(spark):
    rows = made(5, 40) * 5 + [("de", "das ist ein " * 20_000), ("de", "ha " * 30_000)]
    assert mined(spark, rows, top=20) == plain(rows, 3, 20)


def test_ties_at_the_last_rank_go_by_bytes(spark):
    rows = [("en", f"{a} {b}") for a, b in (("z", "é"), ("a", "b"), ("Z", "z"), ("é", "a"), ("c", "d")) for _ in range(4)]
    assert mined(spark, rows, top=3) == plain(rows, 3, 3)


def test_scores_are_exact_where_products_pass_64_bits(spark):
    score = "(cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))"
    r = random.Random(1)
    rows = [(a := r.randint(100, 10**12), r.randint(a, 10**14), r.randint(a, 10**13), r.randint(a, 10**13)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", F.expr(score).alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in got)


def test_a_shift_carries_over_blocks_and_not_over_pieces():
    seq = np.array([0] + [1, 2] * 9 + [0, 2, 1, 0], np.int32)
    maps = phrases.Bitmaps(seq, np.array([0, 1]), np.array([10, 20]))
    assert {tuple(w): n for words, ns in phrases.count_pairs(maps) for w, n in zip(words.tolist(), ns.tolist())} == {(10, 20): 9, (20, 10): 9}


def test_packing_gives_back_what_it_took():
    r = np.random.default_rng(1)
    for size in (0, 1, 1000):
        seq = r.integers(0, 1 << 20, size).astype(np.int32)
        assert np.array_equal(phrases._unpack(size.to_bytes(8, "little") + phrases._planes(seq)), seq)
        words, n = r.integers(0, 50, (size, 3)).astype(np.int32), r.integers(1, 9, size)
        rows = phrases._bucketed(7, words, n, 5)
        back = [(*w, int(x)) for s, _, width, size_, ws, ns in rows for w, x in zip(phrases._words_of(ws, width, size_).tolist(), phrases._planes_back(ns, size_, np.uint32))]
        assert sorted(back) == sorted((*w, int(x)) for w, x in zip(words.tolist(), n)) and len({b for _, b, *_ in rows}) == len(rows)


def test_phrases_of_nothing_and_of_clashing_columns(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None)]) == []
    docs = spark.createDataFrame(made(9, 60), "lang string, text string").withColumns({c: F.lit(1) for c in ("word", "n", "f", "shard", "phrase", "id", "l")})
    assert sorted(tuple(r) for r in phrases.collocations(spark, docs, min_count=3, top=5).collect()) == plain(made(9, 60), 3, 5)
