r"""Quality rules whose cutoffs are fitted under risk control.  DataFrame functions only.

Words are [^\x20\x09-\x0D]+.  A document fails the base rules with fewer than 50 words or with over half
of its words in repeated 3-word windows.  Beyond those, a rule `feature > cutoff` rejects a document.
Cutoffs come from labelled documents, which nothing else is fitted on.  Per stratum (language) and
feature they are tested from the most lenient to the strictest: a cutoff passes while
P(Binomial(n, ALPHA / features) <= k) <= DELTA / (strata * features), k of the stratum's n good documents
being rejected.  That is the exact (Clopper-Pearson) upper bound on its false rejection rate lying under
the limit; testing in a fixed order stops at the first failure and needs no further correction, Bonferroni's
covers strata and features.  So with probability 1 - DELTA no stratum loses more than ALPHA of its good
documents to the rules.  A stratum with too few labels gets no rule.

A null text has no words (and fails the base rules); a null language is a stratum of its own.  A
document labelled both good and bad counts as good; labels of unknown documents count for nothing.
Repeated rows give repeated rows and count once by doc_id in the fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._scratch import Scratch

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS = 50
#: cutoffs by feature, from the most lenient on
GRID = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "repeat_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}
#: above so many repeated windows their positions are found by sorting, not by looking each one up
LOOK_UP = 48
_BLANK = r"[\\x20\\x09-\\x0D]"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: bool = False) -> DataFrame:
    """doc_id, stratum, the counts and the features in GRID for each row of docs; the row too if carry."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None)
    d = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.coalesce(text_col, F.lit("")).alias("text"))
    d = d.withColumns(
        {
            "w": F.expr(rf"filter(split(text, '{_BLANK}+'), x -> x <> '')"),
            "lines": F.expr(rf"filter(split(text, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        }
    )
    d = d.select(
        "row", "doc_id", "stratum", "w",
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr(rf"cast(length(regexp_replace(text, '{_BLANK}+', '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr("cast(regexp_count(text, '[A-Z]') as bigint)").alias("n_upper"),
    )
    d = d.withColumn("h", F.expr("if(n_words < 3, array(), transform(sequence(0, greatest(0, size(w) - 3)), i -> xxhash64(w[i], w[i + 1], w[i + 2])))")).drop("w")
    d = d.withColumn("s", F.sort_array("h"))
    d = d.withColumn("twice", F.expr("filter(s, (x, i) -> i > 0 and s[i - 1] = x)"))
    d = d.withColumn("at", F.expr("case when size(twice) between 1 and %d then filter(sequence(0, size(h) - 1), i -> array_contains(twice, h[i])) end" % LOOK_UP))
    d = d.withColumn("pairs", F.expr("case when size(twice) > %d then sort_array(transform(h, (x, i) -> struct(x as h, i as i))) end" % LOOK_UP)).drop("h", "s")
    d = d.withColumn(
        "at",
        F.expr("""coalesce(at, case when pairs is not null then sort_array(transform(filter(pairs, (x, j) ->
            (j > 0 and pairs[j - 1].h = x.h) or (j + 1 < size(pairs) and pairs[j + 1].h = x.h)), x -> x.i)) end)"""),
    ).drop("pairs", "twice")
    d = d.withColumn("n_repeat_words", F.expr("coalesce(aggregate(transform(at, (x, j) -> if(j + 1 < size(at), least(3, at[j + 1] - x), 3)), 0L, (a, x) -> a + x), 0L)")).drop("at")
    share = lambda a, b: (F.col(a) / F.greatest(F.lit(1), F.col(b)))
    d = d if carry else d.drop("row")
    return d.withColumns({"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars")})


def binomial_tail(k: str, n: str, p: str) -> str:
    """SQL for P(Binomial(n, p) <= k), for k <= n * p; from the largest term down, so that nothing underflows first."""
    log_last = f"aggregate(if({k} > 0, sequence(1L, {k}), cast(array() as array<bigint>)), 0D, (a, i) -> a + ln(({n} - i + 1) / i)) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p})"
    rest = f"""aggregate(if({k} > 0, sequence({k}, 1L, -1L), cast(array() as array<bigint>)), named_struct('t', 1D, 's', 1D),
        (a, i) -> named_struct('t', a.t * i / ({n} - i + 1) * (1 - {p}) / {p}, 's', a.s + a.t * i / ({n} - i + 1) * (1 - {p}) / {p}), a -> a.s)"""
    return f"exp({log_last}) * {rest}"


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, feature, cutoff, n_good, n_rejected): the strictest cutoff that passes, null where none does."""
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("q")).filter("q = 1").select("doc_id")
    known = measured.dropDuplicates(["doc_id"]).join(good, "doc_id", "left_semi")
    level = lambda f: f"size(filter(array({', '.join(f'{c}D' for c in GRID[f])}), c -> {f} > c))"  # noqa: E731  strictest cutoffs last: those passed
    rows = known.select("stratum", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.expr(level(f)).alias("passed")) for f in GRID])).alias("x")).select("stratum", "x.*")
    # a value over the i-th most lenient cutoff is over all stricter ones; `passed` counts them
    counts = rows.groupBy("stratum", "feature", "passed").agg(F.count("*").alias("m")).groupBy("stratum", "feature").agg(F.collect_list(F.struct("passed", "m")).alias("by"))
    grids = F.create_map(*[x for f, g in GRID.items() for x in (F.lit(f), F.array(*[F.lit(float(c)) for c in g]))])
    counts = counts.withColumn("grid", grids[F.col("feature")]).withColumn("n", F.expr("aggregate(by, 0L, (a, x) -> a + x.m)"))
    # cutoff number i (0 is the most lenient) rejects those that pass at least size(grid) - i cutoffs
    tests = counts.withColumn("k", F.expr("transform(grid, (c, i) -> aggregate(filter(by, x -> x.passed >= size(grid) - i), 0L, (a, x) -> a + x.m))"))
    total = tests.select("stratum").distinct().groupBy().agg((F.count("*") * len(GRID)).alias("tests"))
    p = f"{alpha / len(GRID)!r}D"
    good_enough = f"k[i] < n * {p} and {binomial_tail('k[i]', 'n', p)} <= {delta!r}D / tests"
    tests = tests.join(F.broadcast(total)).withColumn("ok", F.expr(f"transform(sequence(0, size(grid) - 1), i -> {good_enough})"))
    tests = tests.withColumn("last", F.expr("coalesce(nullif(array_position(ok, false), 0), size(grid) + 1) - 2"))
    return tests.select("stratum", "feature", F.expr("if(last >= 0, grid[cast(last as int)], null)").alias("cutoff"), F.col("n").alias("n_good"), F.expr("if(last >= 0, k[cast(last as int)], 0L)").alias("n_rejected"))


def _judged(measured: DataFrame, rules: DataFrame) -> DataFrame:
    """measured with base_failed and kept."""
    base = "n_words < %d or 100 * n_repeat_words > 50 * n_words" % MIN_WORDS
    beyond = " or ".join(f"coalesce({f} > max_{f}, false)" for f in GRID)
    return measured.join(rules, F.col("stratum") == F.col("s2"), "left").withColumn("base_failed", F.expr(base)).withColumn("kept", F.expr(f"not base_failed and not ({beyond})"))


def _rules(measured: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per stratum, a cutoff per feature."""
    per = fit(measured, labels).filter("cutoff is not null")
    return scratch.cut(per.groupBy(F.col("stratum").alias("s2")).agg(*[F.max(F.when(F.col("feature") == f, F.col("cutoff"))).alias(f"max_{f}") for f in GRID]), "rules")


def verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs."""
    scratch = Scratch(spark)
    measured = scratch.cut(features(docs), "features")
    got = _judged(measured, _rules(measured, labels, scratch))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep.  Texts are not shuffled: they are measured a second time instead."""
    scratch = Scratch(spark)
    measured = scratch.cut(features(docs), "features")
    got = _judged(features(docs, carry=True), _rules(measured, labels, scratch))
    # a filter is not pushed through inline(); pushed down, it would repeat the features' expressions
    got = got.select(F.inline(F.array(F.struct("row", "kept")))).filter("kept")
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
