"""Exact dedup and the Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(hashes):
    """root and each leaf's siblings, level by level."""
    paths, where, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, at in enumerate(where):
            first = at // 8 * 8
            paths[i].append(("".join(level[first:at]), "".join(level[at + 1 : first + 8])))
        level, where = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], [at // 8 for at in where]
    return level[0], paths


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: h(*[enc(x) for x in (r[0], r[3], r[2], r[4], t)])
    groups = {}
    for r in rows:
        groups.setdefault(b"" if r[2] is None else b"+" + r[2].encode(), []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    tops, out = [], []
    for g in sorted(groups):
        members = sorted(groups[g], key=lambda m: m[:3])
        root, paths = plain_tree([m[2] for m in members])
        tops.append((root, members, paths))
    root, above = plain_tree([t[0] for t in tops])
    for (sub, members, paths), up in zip(tops, above):
        for (_, _, l, r), path in zip(members, paths):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            f = leaf(r, lower(r[1])) if changed else l
            for left, right in path + up:
                f = h(left, f, right)
            out.append((r[0], l, sub, root, h(*[x + y for x, y in path + up]), f, f == root))
    return out


KEY = lambda r: tuple((x is not None, x) for x in r)


def check_manifest(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in merkle.tamper_report(spark, docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=KEY) == sorted(plain_manifest(rows), key=KEY)


def test_manifest_equals_a_plain_tree(spark):
    r = random.Random(3)
    rows = [(r.choice([i, i * 7919, -i, i << 40]), r.choice(["Ab " * (i % 50), "x", None, "", "Größe É"]), r.choice(["en"] * 6 + ["de", "", None, "zz"]), r.choice(["s", None]), i) for i in range(1300)]
    rows = list({x[0]: x for x in rows}.values())
    check_manifest(spark, rows + [(1 << 62, "One", "alone", "s", 3)])


def test_manifest_of_few_rows(spark):
    check_manifest(spark, [(5, "Alone", "en", None, None)])
    for n in (2, 8, 9, 64, 65):
        check_manifest(spark, [(i, f"T{i}", "en", "s", i) for i in range(n)])


def test_manifest_of_ids_that_repeat(spark):
    """Null ids, one id with many texts, and identical rows: more than a bucket takes."""
    rows = [(None, f"Null {i}", "en", "s", i) for i in range(2200)] + [(7, f"Seven {i % 40}", "en", "s", 1) for i in range(2300)] + [(i, "Z", "en", None, 1) for i in range(30)]
    check_manifest(spark, rows + rows[:20])


def test_manifest_of_nothing_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.tamper_report(spark, empty).count() == 0
    rows = [(i, "A", "en", "s", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = docs.withColumns({c: F.lit(9) for c in ("g", "idx", "leaf", "path", "n", "root", "b", "kids", "row_no", "rank")})
    assert sorted(merkle.tamper_report(spark, odd).collect()) == sorted(merkle.tamper_report(spark, docs).collect())


def test_a_changed_text_is_found_and_a_very_long_one_hashed(spark):
    rows = [(i, "Word " * (1 if i else 400_000), "en", "s", 1) for i in range(20)]
    check_manifest(spark, rows)


def plain_copies(rows):
    blank = {ord(c): None for c in " \t\n\v\f\r"}
    groups = {}
    for no, (i, t) in enumerate(rows):
        groups.setdefault((t or "").translate(blank), []).append((-len(t or ""), i is None, i or 0, no, i))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m is best, h(text)) for m in members]
    return sorted(out, key=KEY)


def copies(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted([tuple(r) for r in exact_dedup.duplicates(spark, docs, **how).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=KEY)


ODD = [(1, None), (2, ""), (3, " \n\t\v\f\r"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "a b"), (8, "A b"), (None, "a b "), (9, "é"), (10, "é"), (11, "x\x1cy"), (12, "xy"), (4, "a b"), (4, "a b"), (None, "q"), (None, "q")]


@pytest.mark.parametrize("words", [1, 4, 1 << 20])
def test_copies_equal_plain_grouping_however_small_the_filter(spark, words):
    r = random.Random(words)
    rows = ODD + [(100 + i, " ".join(r.choice(["u", "v", "w"]) for _ in range(r.randint(1, 7)))) for i in range(700)]
    assert copies(spark, rows, max_words=words) == plain_copies(rows)


def test_a_hot_group_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 50)
    rows = [(i, "same text" + " " * (i % 3)) for i in range(400)] + [(1000 + i, "long " * 300_000 + str(i % 2)) for i in range(3)] + ODD
    assert copies(spark, rows) == plain_copies(rows)


def test_rows_that_are_alone_do_not_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(5000 + i, "twice") for i in range(2)], "doc_id long, text string")
    measured = exact_dedup.measure(docs)
    words = exact_dedup.bloom_words(exact_dedup.repeated_cells(measured), 1)
    assert words.count() == 1 and exact_dedup.repeated_cells(measured).count() == 1
    assert sorted(r.n for r in exact_dedup.repeated_cells(measured).collect()) == [2]


def test_copies_of_nothing_and_of_clashing_columns(spark):
    assert copies(spark, []) == []
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("digest", "cell", "row_no", "n", "bits", "hot", "kept", "keep_id", "word")})
    assert [tuple(r) for r in exact_dedup.duplicates(spark, docs).orderBy("doc_id").select("doc_id", "keep_id", "kept").collect()] == [(1, 1, True), (2, 1, False)]
