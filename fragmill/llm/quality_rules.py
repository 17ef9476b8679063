"""Quality rules whose thresholds adapt to each language and source.

Rules are shares: symbols of all word characters, repeated lines of all lines, repeated words
of all words, and the mean word length.  The quantile sketch of a rule counts documents by
logarithmic bins, which keeps a fixed relative accuracy; sketches merge by adding counts, so they are
exact to merge and equal in every run, partitions build theirs before the shuffle, and a hot source arrives as one
row a bin and task.  Sketches are kept by language and source.  Each takes in ``PRIOR`` documents'
worth of its language's sketch, and that of the sketch of all: groups with few documents lean on
those, and no group size switches anything.

A document fails where it lies beyond its group's fence: the median plus (below: less) ``reach``
times the spread, which is the distance from the median to the nearer quartile, scaled to that of a
normal distribution's 90th percentile, or the noise of a document's own count where that is wider,
as most clean groups have no spread at all.  Junk on one side moves only the quartile of its side,
so it doesn't widen the fence while it is less than half of a group.  Beyond that, shares have a
ceiling, and rows above one teach no fence.  Usual word lengths differ so much between languages
that fences of word length are wider for small groups.

DataFrame and SQL functions only.

Defined results: null text has no words and fails the base rules; null language or source is a
group of its own; empty table, empty result; repeated rows are judged alike; other columns
pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import SPACE, WORD, fresh, shared_table

#: rule -> count, of which total, ceiling of the fence above (None: no share), noise of a count (1: that of a Poisson count)
RULES = {
    "symbol_share": ("n_symbols", "word_chars", 0.25, 1.0),
    "dup_line_share": ("n_dup_lines", "n_lines", 0.70, 1.0),
    "repeat_share": ("n_repeat_words", "n_words", 0.50, 1.0),
    "word_length": ("word_chars", "n_words", None, 0.5),
}
#: Rules with a fence below as well, which is also wider for small groups.
BELOW = {"word_length"}
#: Rules whose counts come in bursts, so that their noise grows with the total.
BURSTS = {"repeat_share"}
#: From a normal distribution's median: the 90th percentile by the upper quartile.
TO_Q90 = 1.9
#: Ratio of a sketch's neighbouring bins, and the bin of 0.
GAMMA, ZERO = 1.004, -32768
#: Documents' worth of the wider sketch in each sketch.
PRIOR = 20.0
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """Bind an expression so that lambdas read it instead of evaluating it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort windows, compare neighbours."""

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda x, k: F.when(k + 1 < F.size(at), F.least(F.lit(3), F.get(at, k + 1) - x)).otherwise(3))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, b: a + b)

    def twice(s: Column) -> Column:
        equal = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        at = F.transform(F.filter(s, lambda e, k: equal(e, k - 1) | equal(e, k + 1)), lambda e: e["i"])
        return let(F.sort_array(at), covered)

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows(words)), twice))


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five counts of METRICS and n_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t, w, lines = fresh(docs, "_t", "_w", "_lines")
    counts = {"word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words", "n_lines"}
    base = docs.drop(*[c for c in docs.columns if c in counts]).withColumn(t, text)
    base = base.withColumn(w, F.filter(F.split(t, f"{SPACE}+"), lambda x: x != "")).withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    n = F.size(w)
    return base.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(w), n),
        }
    ).drop(t, w, lines)


def shares() -> dict[str, Column]:
    return {k: F.col(count) / F.greatest(F.col(total), F.lit(1)) for k, (count, total, *_) in RULES.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def under_ceilings() -> Column:
    ok = F.lit(True)
    for k, share in shares().items():
        if RULES[k][2] is not None:
            ok &= share <= RULES[k][2]
    return ok


def bin_of(x: Column) -> Column:
    return F.when(x > 0, F.floor(F.ln(x) / math.log(GAMMA))).otherwise(ZERO).cast("int")


def sketches(scored: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """g_lang, g_source, rule, bin, n: of documents that pass the base rules and ceilings."""
    cells = F.array(*[F.struct(F.lit(k).alias("rule"), bin_of(c).alias("bin")) for k, c in shares().items()])
    rows = scored.where(~base_failed() & under_ceilings()).select(F.col(lang_col).alias("g_lang"), F.col(source_col).alias("g_source"), F.explode(cells).alias("c"))
    return rows.groupBy("g_lang", "g_source", "c.rule", "c.bin").agg(F.count("*").alias("n"))


def _arrays(sketch: DataFrame, *by: str) -> DataFrame:
    """A row for each group: an array of (bin, weight) for each rule, as many entries as bins, and the documents."""
    merged = sketch.groupBy(*by, "rule", "bin").agg(F.sum("n").cast("double").alias("n"))
    entry = F.struct("bin", F.col("n").alias("w"))
    total = F.coalesce(F.sum(F.when(F.col("rule") == next(iter(RULES)), F.col("n"))), F.lit(0.0)).alias("total")
    return merged.groupBy(*by).agg(total, *[F.sort_array(F.collect_list(F.when(F.col("rule") == k, entry))).alias(k) for k in RULES])


def _leaning(own: Column, wider: Column, wider_n: Column) -> Column:
    """``own`` entries with PRIOR documents' worth of the wider sketch, whose weights sum up to ``wider_n``."""
    return F.array_sort(F.concat(own, F.transform(wider, lambda e: F.struct(e["bin"].alias("bin"), (e["w"] * PRIOR / wider_n).alias("w")))))


def _quartiles(entries: Column, total: Column) -> Column:
    """struct<q1, q2, q3> of sorted (bin, weight), as values."""
    at = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    start = F.struct(F.lit(0.0).alias("sum"), *[F.lit(None).cast("int").alias(q) for q in at])

    def step(acc: Column, e: Column) -> Column:
        now = acc["sum"] + e["w"]
        # The last entries reach every quartile, whatever rounding leaves.
        return F.struct(now.alias("sum"), *[F.coalesce(acc[q], F.when(now >= p * total * (1 - 1e-9), e["bin"])).alias(q) for q, p in at.items()])

    value = lambda b: F.when(b == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), b + 0.5))
    return F.aggregate(entries, start, step, lambda acc: F.struct(*[value(acc[q]).alias(q) for q in at]))


def fences(sketch: DataFrame) -> DataFrame:
    """g_lang, g_source, and for each rule the median and the spread; wider: what small groups widen fences by."""
    groups = _arrays(sketch, "g_lang", "g_source")
    langs = _arrays(sketch, "g_lang").withColumnsRenamed({"total": "lang_n", "g_lang": "l_lang"} | {k: f"lang_{k}" for k in RULES})
    everything = _arrays(sketch).withColumnsRenamed({"total": "all_n"} | {k: f"all_{k}" for k in RULES}).withColumn("one", F.lit(1))  # a single row
    langs = langs.withColumn("one", F.lit(1)).join(everything, "one")
    langs = langs.select("l_lang", (F.col("lang_n") + PRIOR).alias("lang_n"), *[_leaning(F.col(f"lang_{k}"), F.col(f"all_{k}"), F.col("all_n")).alias(f"lang_{k}") for k in RULES])
    both = groups.join(langs, groups["g_lang"].eqNullSafe(langs["l_lang"]))
    table = both.select("g_lang", "g_source", (1 + PRIOR / F.col("total")).alias("wider"), *[_quartiles(_leaning(F.col(k), F.col(f"lang_{k}"), F.col("lang_n")), F.col("total") + PRIOR).alias(k) for k in RULES])
    spread = lambda k: TO_Q90 * F.least(F.col(k)["q2"] - F.col(k)["q1"], F.col(k)["q3"] - F.col(k)["q2"])
    return table.select("g_lang", "g_source", "wider", *[x for k in RULES for x in (F.col(k)["q2"].alias(f"{k}_mid"), spread(k).alias(f"{k}_spread"))])


def verdicts(scored: DataFrame, lang_col: str = "lang", source_col: str = "source", reach: float = 6.0) -> DataFrame:
    """``scored`` (from metrics, written once) with base_failed and kept; the fences are written once."""
    limits = shared_table(fences(sketches(scored, lang_col, source_col)), "quality-fences")
    joined = scored.join(limits, scored[lang_col].eqNullSafe(F.col("g_lang")) & scored[source_col].eqNullSafe(F.col("g_source")), "left")
    inside = under_ceilings()  # a group that taught nothing has no fences
    for k, share in shares().items():
        mid, total = F.col(f"{k}_mid"), F.greatest(F.col(RULES[k][1]), F.lit(1))
        noise = RULES[k][3] * F.sqrt(F.greatest(total if k in BURSTS else mid * total, F.lit(1.0))) / total
        far = reach * F.greatest(F.col(f"{k}_spread"), noise)
        far = far * F.col("wider") if k in BELOW else far
        inside &= F.coalesce(share <= mid + far, F.lit(True))
        if k in BELOW:
            inside &= F.coalesce(share >= mid - far, F.lit(True))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & inside}).drop(*limits.columns)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each document: id, counts, base_failed, kept.  The counts are written once."""
    scored = metrics(docs.select(id_col, text_col, lang_col, source_col), text_col).drop(text_col)
    return verdicts(shared_table(scored, "quality-counts"), lang_col, source_col)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows and counts are written to the shared folder once, so the second use neither repeats
    the counting nor shuffles any text.
    """
    stored = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    scored = shared_table(metrics(stored, "text").drop("text"), "quality-rows")
    return verdicts(scored).where("kept").select("row.*")
