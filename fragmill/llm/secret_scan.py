"""Secret scans: fixed formats, and sliding-window Shannon entropy over candidate strings.

Base kinds come from patterns.  Candidates are runs of one character class (hexadecimal
digits, or the base64 alphabet); a window of fixed length slides along each run, and its entropy is kept up
by two count changes a step: the character that leaves and the one that enters.  With c the
count of a character, the window's entropy is log2(w) - sum(c * log2 c) / w, so a step changes
the sum by four table look-ups.  A run whose largest window entropy reaches the class's
threshold becomes a span of kind ``entropy`` unless the allow-list suppresses it.

Positions come from the lengths of matches and of the text between them, by running sums that work
block by block, so that a text with very many matches takes little more than linear time.
DataFrame and SQL functions only: one narrow map, no shuffle.

Defined results: null or empty text has no spans; repeated rows are scanned alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their listed order: pattern of a match. Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the entropy method: class -> (pattern, characters, threshold in bits).
#: One may follow '=', as in KEY=value; before another character, '=' is no padding but ends a name.
CLASSES = {
    "hex": (r"(?<![A-Za-z0-9+/_-])[0-9a-fA-F]{20,}(?![A-Za-z0-9+/=_-])", "0123456789abcdefABCDEF", 3.0),
    "base64": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 3.8),
}
WINDOW = 20
#: Candidates that match any of these are no secrets: digits only, one repeated unit, placeholders, paths.
ALLOW = (r"^[0-9]+$", r"^(.{1,4})\1+.{0,3}$", r"(?i)(example|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh)", r"^(/[a-z0-9_-]+)+$")


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, op, zero: Column) -> Column:
    """For each value, ``op`` over all values before it; in blocks of the root of their number, as each step copies its block."""

    def run(block: Column) -> Column:
        start = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(op(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))

    def in_blocks(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: run(F.slice(v, k * width + 1, width)))

        def joined_up(blocks: Column) -> Column:
            bases = run(F.transform(blocks, lambda x: x["now"]))["out"]
            return let(bases, lambda base: F.flatten(F.transform(blocks, lambda x, k: F.transform(x["out"], lambda y: op(F.get(base, k), y)))))

        return F.when(F.size(v) == 0, F.slice(F.array(zero), 1, 0)).otherwise(let(cut, joined_up))

    return let(values, in_blocks)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t>>: start, end (code points) and string of each match, leftmost first."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def placed(m: Column) -> Column:
        def all_of(gaps: Column) -> Column:
            steps = F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))

            def spans(at: Column) -> Column:
                start = lambda i: F.get(at, i) + F.length(F.get(gaps, i))
                return F.transform(m, lambda x, i: F.struct(start(i).alias("s"), (start(i) + F.length(x)).alias("e"), x.alias("t")))

            return let(before(steps, lambda x, y: x + y, F.lit(0)), spans)

        return F.when(F.size(m) == 0, none).otherwise(let(between, all_of))

    return let(found, placed)


def window_entropy(s: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of any ``window`` consecutive characters, in bits."""
    table = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])

    def slide(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            leaves = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0))

            def changed(io: Column) -> Column:
                a, b = io["a"], io["b"]
                ca, cb = F.element_at(acc["n"], a), F.when(b > 0, F.get(acc["n"], b - 1)).otherwise(F.lit(0))
                up = F.get(table, ca + 1) - F.get(table, ca)
                down = F.get(table, cb) - F.get(table, F.greatest(cb - 1, F.lit(0)))
                total = F.when(a == b, acc["sum"]).otherwise(acc["sum"] + up - F.when(b > 0, down).otherwise(F.lit(0.0)))
                n = F.when(a == b, acc["n"]).otherwise(F.transform(acc["n"], lambda c, k: c + F.when(k == a - 1, 1).otherwise(0) - F.when(k == b - 1, 1).otherwise(0)))
                h = math.log2(window) - total / window
                return F.struct(n.alias("n"), total.alias("sum"), F.when(i >= window - 1, F.greatest(acc["max"], h)).otherwise(acc["max"]).alias("max"))

            return let(F.struct(F.get(codes, i).alias("a"), leaves.alias("b")), changed)

        start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).cast("double").alias("max"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step)["max"]

    return let(F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c)), slide)


def allowed(s: Column) -> Column:
    """Is the candidate on the allow-list?"""
    hit = F.lit(False)
    for pattern in ALLOW:
        hit |= s.rlike(pattern)
    return hit


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: id, assign, access, hex, entropy: array<struct<s, e, t>>."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    assign = F.filter(matches(F.col("text"), ASSIGN), lambda m: F.length(F.regexp_extract(m["t"], ASSIGN, 1)) >= 6)
    spans = text.select("doc_id", "text", assign.alias("assign"), matches(F.col("text"), ACCESS).alias("access"), matches(F.col("text"), HEX).alias("hex"))
    secret = lambda alphabet, least: lambda m: ~allowed(m["t"]) & (window_entropy(m["t"], alphabet, window) >= least)
    extra = [F.filter(matches(F.col("text"), pattern), secret(alphabet, least)) for pattern, alphabet, least in CLASSES.values()]
    spans = spans.select("doc_id", "assign", "access", "hex", F.concat(*extra).alias("entropy"))
    return spans.withColumn("entropy", outside(F.col("entropy"), F.concat("assign", "access", "hex")))


def outside(found: Column, base: Column) -> Column:
    """``found`` in order, without those inside a base span or found twice: one pass over both, sorted by start."""
    tag = lambda k: lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), m["t"].alias("t"))
    events = F.array_sort(F.concat(F.transform(base, tag(0)), F.transform(found, tag(1))))

    def kept(x: Column) -> Column:
        ends = F.transform(x, lambda m: F.when(m["k"] == 0, m["e"]).otherwise(0))

        def alone(reach: Column) -> Column:
            # The base span that reaches farthest, of those that start no later, holds the run or none does.
            own = lambda m, i: (m["k"] == 1) & (F.get(reach, i) < m["e"]) & ~F.coalesce(F.get(x, i - 1) == m, F.lit(False))
            return F.transform(F.filter(x, own), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["t"].alias("t")))

        return let(before(ends, F.greatest, F.lit(0)), alone)

    return F.when(F.size(found) == 0, found).otherwise(let(events, kept))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def kinds(*cols: str) -> Column:
    """All spans of the named columns as array<struct<s, o, kind, e>>, to be ordered by start, then kind as listed."""
    tag = lambda o, c: lambda m: F.struct(m["s"].alias("s"), F.lit(o).alias("o"), F.lit(c).alias("kind"), m["e"].alias("e"))
    return F.concat(*[F.transform(F.col(c), tag(o, c)) for o, c in enumerate(cols)])
