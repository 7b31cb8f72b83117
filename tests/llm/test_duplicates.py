"""Near-duplicate joins, line and passage dedup against brute force, and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import jaccard_join, line_dedup, substring_dedup
from docloom.llm._graph import components
from docloom.llm._scratch import Scratch

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k=3, percent=90):
    sets = [shingles(t, k) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed,chunk,k,percent", [(1, None, 3, 90), (2, 50, 3, 90), (3, 7, 5, 80), (4, None, 5, 80), (5, None, 2, 60)])
def test_links_agree_with_brute_force(spark, monkeypatch, seed, chunk, k, percent):
    if chunk:
        monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", chunk)
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(160):
        if texts and r.random() < 0.7:
            w = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = f"n{r.randint(0, 500)}"
            t = " ".join(w)
        else:
            t = " ".join(f"{r.choice('abcdEFG')}{r.randint(0, 30)}" for _ in range(r.choice([0, 1, 2, 3, 12, 21, 40, 90, 200])))
        texts.append(t)
        rows.append((1000 - i, t))
    rows += [(1, ""), (2, "  \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in jaccard_join.link_components(spark, df, words=k, percent=percent).collect()) == brute_components(rows, k, percent)


def test_links_of_a_chain_of_near_copies(spark):
    """Neighbours link, ends do not: one component all the same."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(["x%d" % j if j < 2 * i else w for j, w in enumerate(base)])) for i in range(25)]
    got = sorted(tuple(x) for x in jaccard_join.link_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_links_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (4, "ONE  two"), (None, "one two"), (5, "word " * 30000)]
    got = sorted((tuple(x) for x in jaccard_join.link_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3), (None, 1, 3), (5, 1, 5)], key=repr)
    assert jaccard_join.link_components(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent,limit", [(90, 0), (80, 0), (80, 3), (60, 0)])
def test_linked_sets_share_a_signature(percent, limit):
    """Pairs that differ in as much as a link allows, most of all, for any table of common shingles."""
    r = np.random.default_rng(percent + limit)
    for _ in range(400):
        n = int(r.choice([1, 2, 3, 5, 8, 13, 30, 64, 127, 128, 300, 700]))
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        gone = int(r.integers(0, max(1, n * (100 - percent) // 100) + 1))
        fresh = int(r.integers(0, max(1, n * (100 - percent) // percent) + 1))
        b = np.concatenate((a[gone:], r.integers(0, 1 << 63, fresh).astype(np.uint64)))
        common = np.sort(r.choice(np.concatenate((a, b)), limit * n // 4)) if limit else None
        a, b = np.unique(a), np.unique(b)
        same = len(np.intersect1d(a, b))
        if not len(b) or 100 * same < percent * (len(a) + len(b) - same) or len(a) == len(b) == same:
            continue
        s, c = np.concatenate((a, b)), np.array([len(a), len(b)])
        text, sig = jaccard_join.signatures(s, c, percent, common)
        assert set(sig[text == 0]) & set(sig[text == 1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 103), (103, 101), (7, 200)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 100: 100, 103: 100, 101: 100, 7: 7, 200: 7}


# --- 5 -------------------------------------------------------------------------------------------
def brute_lines(rows):
    """Every selected shingle against its first place, and every line of the diagonal between them looked at."""
    docs, chosen = {}, {}
    for d, t in sorted(rows):
        lines = [x.strip(" \t\r\x0b\x0c") for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        units = [(i, j) for i, x in enumerate(lines) for j in range(-(-len(x.split()) // line_dedup.UNIT_WORDS))]
        g = [hashlib.md5("|".join(f"{hashlib.md5(lines[i].encode()).hexdigest()}.{j}" for i, j in units[k : k + 3]).encode()).hexdigest()[:16] for k in range(len(units) - 2)]
        picked = {max(k for k in w if g[k] == min(g[j] for j in w)) for w in (range(k, min(k + 3, len(g))) for k in range(max(1, len(g) - 2) if g else 0))}
        docs[d], chosen[d] = lines, [(g[k], units[k][0]) for k in sorted(picked)]
    first, gone = {}, {d: set() for d in docs}
    for d in docs:
        for g, p in chosen[d]:
            e, q = first.setdefault(g, (d, p))
            if (e, q) != (d, p):
                for step in (1, -1):
                    k = 0
                    while 0 <= p + k < len(docs[d]) and 0 <= q + k < len(docs[e]) and docs[d][p + k] == docs[e][q + k]:
                        gone[d].add(p + k)
                        k += step
    return {d: ([x for i, x in enumerate(docs[d]) if i not in gone[d]], len(gone[d])) for d in docs}


def kept_lines(text):
    return [y.strip(" \t\r\x0b\x0c") for y in text.split("\n") if y.strip(" \t\r\x0b\x0c")]


@pytest.mark.parametrize("seed", [7, 8])
def test_line_dedup_agrees_with_brute_force(spark, seed):
    r = random.Random(seed)
    some = ["a", "b", " c", "d\r", "", "é", "f f", "w " * 25, "x y " * 9, *map(str, range(8 * (seed - 7)))]
    rows = [(i, "\n".join(r.choice(some) for _ in range(r.randint(0, 25)))) for i in range(80)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = {x.doc_id: (kept_lines(x.text), x.n_removed_lines) for x in line_dedup.remove_repeated_lines(spark, df).collect()}
    assert got == brute_lines(rows)


def test_fingerprints_are_sparse_and_guaranteed():
    """Fewer than the shingles, and one in common of any five units that two texts share."""
    r = random.Random(3)
    for _ in range(300):
        shared = [b"line %d" % r.randint(0, 10**6) for _ in range(5)]
        one, two = ([b"%d" % r.randint(0, 10**9) for _ in range(r.randint(0, 9))] + shared + [b"%d" % r.randint(0, 10**9) for _ in range(r.randint(0, 9))] for _ in range(2))
        assert {g for g, _ in line_dedup.fingerprints(one)[1]} & {g for g, _ in line_dedup.fingerprints(two)[1]}
    lines = [b"%d" % i for i in range(3000)]
    assert 0.4 < len(line_dedup.fingerprints(lines)[1]) / len(lines) < 0.6


def test_repeated_runs_go_and_one_long_line_too(spark):
    r = random.Random(4)
    long, run = " ".join(f"w{r.randint(0, 9999)}" for _ in range(45)), [f"line {r.randint(0, 9999)} of it" for _ in range(5)]
    rows = [(i, "\n".join([f"own {i} a", *part, f"own {i} b"])) for i, part in enumerate([[long], run, [long], run, ["x", *run, long]])]
    got = {x.doc_id: kept_lines(x.text) for x in line_dedup.remove_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ["own 0 a", long, "own 0 b"], 1: ["own 1 a", *run, "own 1 b"], 2: ["own 2 a", "own 2 b"], 3: ["own 3 a", "own 3 b"], 4: ["own 4 a", "x", "own 4 b"]}


def test_line_dedup_of_odd_rows(spark):
    t = "a\nb\nc\nd\ne"
    rows = [(1, None), (2, ""), (3, t), (3, t), (4, f"x\n\n{t}\n\ny"), (None, t), (5, "\n".join(map(str, range(30000))))]
    df = spark.createDataFrame([(*x, 7, 8, 9) for x in rows], "doc_id long, text string, line int, doc int, n_removed_lines int")
    got = sorted(((x.doc_id, x.text, x.line, x.doc, x.n_removed_lines) for x in line_dedup.remove_repeated_lines(spark, df).collect()), key=repr)
    assert got == sorted([(1, None, 7, 8, 0), (2, "", 7, 8, 0), (3, t, 7, 8, 0), (3, t, 7, 8, 0), (4, "x\n\n\ny", 7, 8, 5), (None, t, 7, 8, 0), (5, rows[-1][1], 7, 8, 0)], key=repr)
    assert line_dedup.remove_repeated_lines(spark, df.limit(0)).count() == 0


# --- 3 -------------------------------------------------------------------------------------------
def words(r, n):
    return ["%s%d" % (r.choice("abcdefgh"), r.randint(0, 4000)) for _ in range(n)]


def test_passages_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(8)
    rows, planted = [], set()
    passage, fuzzy = words(r, 60), words(r, 90)
    for i in range(60):
        w = words(r, r.randint(30, 300))
        at = r.randint(0, len(w))
        if i % 5 == 0:
            w[at:at] = passage
            planted.add(i)
        elif i % 5 == 1:
            w[at:at] = [x if r.random() > 0.04 else "changed%d" % r.randint(0, 99) for x in fuzzy]
            planted.add(i)
        rows.append((i, " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = substring_dedup.repeated_passages(spark, df).collect()
    assert {x.doc_id for x in got} | {x.source_doc_id for x in got} == planted
    text = {x[0]: x[1].encode() for x in rows}
    for x in got:
        assert x.source_doc_id < x.doc_id and x.similarity >= 0.8
        if x.doc_id % 5 == 0:
            assert " ".join(passage).encode() in text[x.doc_id][x.start_byte : x.end_byte]
            assert " ".join(passage).encode() in text[x.source_doc_id][x.source_start_byte : x.source_end_byte]


def test_passages_of_recombined_sentences(spark):
    """The seeds of both sentences are first found in two other documents, only the whole in the third."""
    r, rows = random.Random(13), []
    for i in range(0, 160, 4):
        one, two = words(r, 40), words(r, 40)
        rows += [(i + j, " ".join(words(r, 60) + w + words(r, 60))) for j, w in enumerate((one, two, one + two, one + two))]
    got = substring_dedup.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(x.doc_id, x.source_doc_id) for x in got} == {(i + 3, i + 2) for i in range(0, 160, 4)}
    assert all(x.n_words >= 80 for x in got)


def test_every_copy_of_a_passage_is_found(spark):
    """A document that holds an earlier one's text several times, one that quotes a part of it first, and runs."""
    r = random.Random(14)
    text, lone = words(r, 60), words(r, 30)
    held = [words(r, 30) + text + words(r, 30), sum((words(r, 40) + text for _ in range(5)), []), words(r, 50) + text[:35] + words(r, 50) + text + words(r, 50)]
    runs = [words(r, 20) + ["and"] * 60 + words(r, 20), words(r, 20) + ["and"] * 700 + words(r, 20), words(r, 20) + lone * 2 + words(r, 20), words(r, 20) + lone * 13 + words(r, 20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(held + runs)]
    got = substring_dedup.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, n, part in ((1, 5, text), (2, 1, text), (4, 1, ["and"] * 700), (6, 1, lone * 13)):
        full, part = rows[i][1], " ".join(part)
        spans = [(x.start_byte, x.end_byte) for x in got if x.doc_id == i]
        covered = {b for lo, hi in spans for b in range(lo, hi)}
        at = [m.start() for m in re.finditer(re.escape(part), full)]
        assert len(at) == n and all(b in covered or full[b] == " " for a in at for b in range(a, a + len(part)))


def test_passages_with_many_changes_are_found(spark):
    r, rows, least = random.Random(15), [], {(55, 0.82): 0.8, (55, 0.85): 0.88, (80, 0.8): 0.92, (80, 0.85): 0.98}
    pairs = {k: [] for k in least}
    for n, alike in least:
        for _ in range(100):
            p = words(r, n)
            q = list(p)
            for j in r.sample(range(n), int(n * (1 - alike) + 1e-9)):
                q[j] = "new%d" % r.randint(0, 9999)
            pairs[n, alike].append((len(rows) + 1, len(rows)))
            rows += [(len(rows) + i, " ".join(words(r, 60) + w + words(r, 60))) for i, w in enumerate((p, q))]
    got = {(x.doc_id, x.source_doc_id) for x in substring_dedup.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, every in pairs.items():
        assert sum(x in got for x in every) >= least[k] * len(every), k
    assert got <= {x for every in pairs.values() for x in every}


def test_short_passages_with_changes_within_are_found(spark):
    """Words replaced, or taken out on one side and put in on the other; the first and last word are shared."""
    r, rows = random.Random(18), []
    least = {(45, 0.8, "sub"): 0.85, (45, 0.85, "sub"): 0.95, (55, 0.8, "sub"): 0.93, (45, 0.85, "in"): 0.8, (55, 0.85, "in"): 0.8, (55, 0.9, "in"): 0.95}
    pairs = {k: [] for k in least}
    for n, alike, how in least:
        for _ in range(80):
            p, k = words(r, n), int(n * (1 - alike) + 1e-9)
            q = list(p)
            for j in sorted(r.sample(range(1, n - 1), k), reverse=True):
                q[j : j + 1] = ["new%d" % r.randint(0, 9999)] if how == "sub" else []
            for _ in range(k if how == "in" else 0):
                q.insert(r.randint(1, len(q) - 1), "new%d" % r.randint(0, 9999))
            pairs[n, alike, how].append((len(rows) + 1, len(rows)))
            rows += [(len(rows) + i, " ".join(words(r, 90) + w + words(r, 90))) for i, w in enumerate((p, q))]
    got = substring_dedup.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.similarity >= 0.8 for x in got)
    found = {(x.doc_id, x.source_doc_id) for x in got}
    for k, every in pairs.items():
        assert sum(x in found for x in every) >= least[k] * len(every), k
    assert found <= {x for every in pairs.values() for x in every}


def test_passages_in_slices_of_long_words_are_found(spark):
    """A passage of 45 words that is longer than the slice about its chain."""
    r, rows = random.Random(19), []
    for _ in range(20):
        p = ["%020d" % r.randint(0, 10**19) for _ in range(50)]
        q = ["new" + w if i % 9 == 6 else w for i, w in enumerate(p)]
        q[10:11], q[30:30] = [], ["put", "in"]
        rows += [(len(rows) + i, " ".join(words(r, 90) + w + words(r, 90))) for i, w in enumerate((p, q))]
    got = {(x.doc_id, x.source_doc_id) for x in substring_dedup.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {(i + 1, i) for i in range(0, 40, 2)} and len(got) >= 18


def test_passages_through_a_pair_of_words_agree_with_all_windows(monkeypatch):
    r = random.Random(20)
    monkeypatch.setattr(substring_dedup, "MIN_WORDS", 5)
    monkeypatch.setattr(substring_dedup, "REACH", 8)
    monkeypatch.setattr(substring_dedup, "END_GAP", 99)
    lcs, cases = substring_dedup.common_length, []
    for _ in range(150):
        one, two = ([r.randint(0, 4) for _ in range(r.randint(1, 10))] for _ in range(2))
        cases.append((one, two, r.randint(0, len(one)), r.randint(0, len(two))))
    got = substring_dedup.through(*map(list, zip(*cases)))
    for (w1, w2, i, j), x in zip(cases, got):
        score = lambda a, b, c, d: 5 * (lcs(w1[a:i], w2[c:j]) + lcs(w1[i:b], w2[j:d])) - 2 * (b - a + d - c)
        ends = lambda a, b, c, d: ((a, c) == (i, j) or (a < i and c < j and w1[a] == w2[c])) and ((b, d) == (i, j) or (b > i and d > j and w1[b - 1] == w2[d - 1]))
        near = [(a, b, c, d) for a in range(max(0, i - 8), i + 1) for b in range(i, min(len(w1), i + 8) + 1) for c in range(max(0, j - 8), j + 1) for d in range(j, min(len(w2), j + 8) + 1)]
        every = [score(*w) for w in near if ends(*w) and max(w[1] - w[0], w[3] - w[2]) >= 5]
        best = max(every, default=-1)
        assert (x is None) == (best < 0)
        if x:
            assert ends(*x) and max(x[1] - x[0], x[3] - x[2]) >= 5 and score(*x) == best


def brute_passages(rows, least=51):
    """The words of later documents that lie in a run of `least` words which an earlier document has too."""
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = t.translate(LOW).split()
        hit = set()
        for i in range(len(w) - least + 1):
            if seen.setdefault(tuple(w[i : i + least]), d) != d:
                hit.update(range(i, i + least))
        out[d] = hit
    return out


def test_every_shared_run_is_covered_however_rows_are_dealt(spark):
    """The query against brute force: the words of runs over 50 words that an earlier document has, but for few at a run's end
    whose first copy ends earlier; whatever the partitions."""
    r = random.Random(16)
    pool = [words(r, r.randint(40, 120)) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [words(r, r.randint(5, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randint(0, len(p) - 30)
            parts += [p[a : a + r.randint(30, 120)], words(r, r.randint(0, 40))]
        rows.append((i, " ".join(sum(parts, []))))
    rows += [(200, rows[5][1] + " " + rows[6][1]), (201, " ".join(words(r, 3000))), (202, "x " * 30 + rows[7][1])]
    rows += [(203, rows[-2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(tuple(x) for x in substring_dedup.repeated_passages(spark, d).collect()) for d in (df.repartition(7), df.coalesce(1))]
    assert got[0] == got[1]
    text, covered = dict(rows), {}
    for d, _, a, b, *_ in got[0]:
        covered.setdefault(d, set()).update(range(a, b))
    for d, hit in brute_passages(rows).items():
        at = [m.start() for m in re.finditer(r"\S+", text[d])]
        inner = {k for k in hit if all(j in hit for j in range(k - substring_dedup.LONG_W + 1, k + substring_dedup.LONG_W))}
        assert all(at[k] in covered.get(d, ()) for k in inner), d
    for d, source, a, b, c, e, n, alike in got[0]:
        one, two = text[d].translate(LOW).encode()[a:b].split(), text[source].translate(LOW).encode()[c:e].split()
        assert len(one) == n and source < d and alike >= 0.8 and abs(alike - 2 * substring_dedup.common_length(list(map(hash, one)), list(map(hash, two))) / (len(one) + len(two))) < 1e-9


def test_passages_longer_than_a_slice_end_where_they_end(spark):
    """A copy of which all but a few seeds are first found elsewhere: the passage still reaches over it."""
    r = random.Random(17)
    text = words(r, 900)
    pieces = [(i, " ".join(words(r, 10) + text[a : a + 50] + words(r, 10))) for i, a in enumerate(range(0, 900, 60))]
    rows = [*pieces, (50, " ".join(text)), (51, " ".join(words(r, 30) + text + words(r, 30)))]
    got = [x for x in substring_dedup.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.doc_id == 51]
    covered = {b for x in got for b in range(x.start_byte, x.end_byte)}
    at = rows[-1][1].index(" ".join(text))
    assert all(b in covered or rows[-1][1][b] == " " for b in range(at, at + len(" ".join(text))))


def test_passages_of_odd_rows(spark):
    long = " ".join(words(random.Random(9), 30000))
    rows = [(1, None), (2, ""), (3, "a b"), (None, long), (4, long), (4, long), (5, long), (6, "and " * 500), (7, "and " * 400)]
    got = substring_dedup.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.source_doc_id) for x in got} == {(5, 4), (7, 6)}
    assert substring_dedup.repeated_passages(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_scores_agree_with_all_pairs():
    r = random.Random(10)
    for _ in range(100):
        n = r.randint(1, 12)
        seg = sorted((r.randint(0, 200), r.randint(0, 200), r.randint(1, 30)) for _ in range(n))
        x, y, length = map(list, zip(*seg))
        f = []
        for i in range(n):
            best = max([f[j] - substring_dedup.GAP_COST * (x[i] - x[j] - length[j] + y[i] - y[j] - length[j]) for j in range(i) if x[j] + length[j] <= x[i] and y[j] + length[j] <= y[i]], default=0)
            f.append(length[i] + max(0, best))
        chains = substring_dedup.chain(x, y, length)
        assert max(c[0] for c in chains) == pytest.approx(max(f))
        assert sorted(i for _, part in chains for i in part) == list(range(n))


def test_common_length_agrees_with_dynamic_programming():
    r = random.Random(11)
    for _ in range(200):
        a, b = [r.randint(0, 5) for _ in range(r.randint(0, 30))], [r.randint(0, 5) for _ in range(r.randint(0, 30))]
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, z in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == z else max(d[i][j + 1], d[i + 1][j])
        assert substring_dedup.common_length(a, b) == d[-1][-1]


# --- pipeline --------------------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    prose = lambda n: "\n".join(" ".join("%s%d" % (r.choice("abcdefgh"), r.randint(0, 9999)) for _ in range(20)) for _ in range(n))
    clean = {i: prose(6) for i in range(10, 40)}
    item = " ".join(words(r, 14))
    copy = clean[10].split("\n")
    copy = "\n".join(line.replace(line.split()[0], "zz", 1) if k % 2 else line for k, line in enumerate(copy))  # no run of three lines is left
    rows = [(i, t) for i, t in clean.items()] + [(50, "too short"), (51, None), (52, clean[11]), (53, copy), (54, prose(3) + "\n" + item + "\n" + prose(3)), (55, prose(3) + "\n" + clean[12] + "\n" + prose(3)), (20, clean[20])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(x.doc_id for x in docs.collect())
    assert seen["quality_rules"] == sorted([*clean, 20, 52, 53, 54, 55])
    assert seen["line_dedup"] == sorted([*clean, 20, 53, 54, 55])
    assert seen["near_duplicates"] == sorted([*clean, 53, 54, 55])  # 53 shares 101 of 131 shingles of five words with 10
    assert 54 not in seen["decontamination"] and set(clean) <= set(seen["decontamination"])
    assert seen["bpe"] == seen["decontamination"]
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == seen["bpe"]


def test_pipeline_of_odd_and_of_no_rows(spark, tmp_path):
    """Nulls, repeated rows, rows without doc_id and one very long text; then an empty table: every stage gives rows of its columns."""
    import corpus_pipeline

    r = random.Random(22)
    long, text = " ".join(words(r, 20000)), "\n".join(" ".join(words(r, 20)) for _ in range(5))
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text.replace(" ", "  ")), (4, long), (5, text + "\n" + " ".join(words(r, 70)))]
    for name, part in (("odd", rows), ("none", [])):
        top = tmp_path / name
        spark.createDataFrame([(i, t, "en", None, 1) for i, t in part], DOCS).write.parquet(str(top / "documents.parquet"))
        spark.createDataFrame([(1, "no such words at all in any of these texts here")], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
        docs = spark.read.parquet(str(top / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(top))
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(str(top / f"stage{k}"))
            docs = spark.read.parquet(str(top / f"stage{k}"))
        assert sorted((x.doc_id or 0 for x in docs.collect())) == ([0, 3, 4, 5] if part else [])
        assert corpus_pipeline.run(spark, str(top)).count() == docs.count()


def test_pipeline_keeps_columns_that_clash(spark, tmp_path):
    """Columns named like those of the operators come back as they went in, and texts under one doc_id both stay."""
    import corpus_pipeline

    r = random.Random(31)
    texts = ["\n".join(" ".join(words(r, 20)) for _ in range(5)) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts[:3])] + [(1, texts[3], "en", "s", 9), (1, texts[1], "de", "s", 9), (None, texts[3] + " more", "en", "s", 1)], DOCS)
    names = ("hit", "n_removed_lines", "row", "other_columns", "kept", "digest", "key", "n", "copy", "stratum", "n_words", "map")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("n_chars")) if c != "map" else F.create_map(F.lit("a"), F.lit(1)) for c in names})
    spark.createDataFrame([(1, "no such words at all in any of these texts here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert all(x[c] == f"{c}{x.n_chars}" or name == "line_dedup" and x[c].startswith(c) for x in rows for c in names if c != "map"), name
        if name != "line_dedup":  # the copy under doc_id 1 is a repeated row; which of its two languages stays is fixed
            assert sorted((-1 if x.doc_id is None else x.doc_id, texts.index(x.text) if x.text in texts else 9) for x in rows) == ([(-1, 9), (0, 0), (1, 1), (1, 3), (2, 2)] if name == "near_duplicates" else sorted((-1 if x.doc_id is None else x.doc_id, texts.index(x.text) if x.text in texts else 9) for x in docs.collect())), name


def test_classes_of_rows_without_doc_id_are_linked(spark):
    r = random.Random(33)
    base = [words(r, 120) for _ in range(6)]
    near = [[*w[:60], "zz", *w[61:]] for w in base]
    rows = [(None, " ".join(w)) for w in base for _ in range(5)] + [(None, " ".join(w)) for w in near[:3]] + [(10 + i, " ".join(w)) for i, w in enumerate(near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.link_components(spark, docs).collect()
    assert sorted((x.doc_id or 0, x.component_id) for x in got) == sorted([(0, 10 + i) for i in range(6) for _ in range(5)] + [(0, 10 + i) for i in range(3)] + [(10 + i, 10 + i) for i in range(6)])
