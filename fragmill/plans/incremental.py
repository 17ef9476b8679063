"""Byte-pair training on Spark whose rounds cost what their merges touch.

The words are in an inverted index, a row for each pair and word that holds it, with the word as it stands, sorted by
pair in each file: a round reads the rows of its pairs and no others.  A word that changes is written anew for all its
pairs under the round's number, and as gone (null) for those that it no longer holds, so the last row of a pair and word
is the truth.  Old rows are dropped every few rounds.  Counts of pairs are a table of their own, brought up to date by signed
differences of the changed words: old pairs down, new pairs up.  It grows with the pairs, not with the words.

A round takes as many of the best pairs as are sure to come next one after the other.  A merge of (a, b) changes
the counts of pairs (x, a) and (b, y) only, and what it makes is no more frequent than those were; so the next pair
in line stays next if no pair at least as frequent as itself, itself included, overlaps an earlier one of the round so.
A pair of equals overlaps itself and ends its round.  The driver sees ``LINE`` pairs of the table at a time; if ties reach beyond
its end, the round ends before them.  Merges are those of ``trainer.learn``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fragmill.operators import tokens as tk
from fragmill.sources.shared import drop_paths, shared_file

#: Pairs of the table of counts that the driver reads for a round.
LINE = 512


def next_merges(line: list[tuple[int, int, int]], most: int, whole: bool) -> list[tuple[int, int]]:
    """The first pairs of ``line`` (left, right, n; best first) that are sure to be merged one after the other.

    ``whole``: there are no pairs behind the line.
    """
    taken: list[tuple[int, int]] = []
    firsts: set[int] = set()
    seconds: set[int] = set()
    last = line[-1][2] if line and not whole else None
    at = 0
    for left, right, n in line:
        if len(taken) == most or (taken and n == last):
            break
        while at < len(line) and line[at][2] >= n:  # pairs at least as frequent: none may overlap an earlier merge
            at += 1
        if any((b in firsts or a in seconds) for a, b, _ in line[:at]):
            break
        taken.append((left, right))
        firsts.add(left)
        seconds.add(right)
        if left == right:
            break
    return taken


def _rows(changed: DataFrame, generation: int) -> DataFrame:
    """Rows of the index for changed words: pair, id, generation, word (null: no longer holds the pair), n."""
    old, new = tk.adjacent_pairs(F.col("old")), tk.adjacent_pairs(F.col("word"))
    held = changed.select("id", "n", "word", new.alias("now"), F.explode(F.array_union(old, new)).alias("pair"))
    return held.select("pair", "id", F.lit(generation).alias("generation"), F.when(F.array_contains("now", F.col("pair")), F.col("word")).alias("word"), "n")


def _differences(changed: DataFrame) -> DataFrame:
    """pair, n: by how much the changed words change each pair's count."""
    signed = lambda word, n: changed.select(F.explode(tk.adjacent_pairs(F.col(word))).alias("pair"), n.alias("n"))
    return signed("old", -F.col("n")).unionByName(signed("word", F.col("n"))).groupBy("pair").agg(F.sum("n").alias("n"))


def _live(index: DataFrame) -> DataFrame:
    """The last row of each pair and word, if the word still holds the pair."""
    last = index.groupBy("pair", "id").agg(F.max_by(F.struct("word", "n"), "generation").alias("x"), F.max("generation").alias("generation"))
    return last.where(F.col("x.word").isNotNull()).select("pair", "id", "generation", "x.word", "x.n")


def _applied(word: Column, merges: list[tuple[int, int]], first: int) -> Column:
    for k, (left, right) in enumerate(merges):
        word = tk.merged(word, left, right, first + k)
    return word


def learn_incremental(counts: DataFrame, n_merges: int, every: int = 20, line: int = LINE, log: list[dict] | None = None) -> list[tuple[int, int]]:
    """Merges of counts(fragment, n).  ``log`` takes a row for each round: merges, rows_read (of the index), words (changed).

    Empty fragments and those of one byte have no pairs; an empty table gives no merges; fragments that repeat count
    together; equal counts go by the smaller left, then right token.
    """
    spark = counts.sparkSession
    made: list[str] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(shared_file(spark, f"bpe-{name}"))
        schema = df.schema
        df.write.parquet(made[-1])
        return spark.read.schema(schema).parquet(made[-1])

    def dropped(keep: list[str]) -> None:
        drop_paths(spark, [p for p in made if p not in keep])
        made[:] = keep

    try:
        words = written(counts.where(F.col("fragment").isNotNull()).select(F.monotonically_increasing_id().alias("id"), tk.byte_word(F.col("fragment")).alias("word"), F.col("n").cast("long").alias("n")), "words")
        first = written(_rows(words.withColumn("old", F.lit("")), 0).sortWithinPartitions("pair"), "index")
        parts = [made[-1]]
        pairs = written(tk.pair_counts(words), "pairs")
        dropped([*parts, made[-1]])
        schema, merges, generation = first.schema, [], 0
        while len(merges) < n_merges:
            best = pairs.orderBy(F.col("n").desc(), F.ascii("pair"), F.ascii(F.substring("pair", 2, 1))).limit(line).collect()  # ``line`` rows
            seen = [(tk.token(r["pair"][0]), tk.token(r["pair"][1]), r["n"]) for r in best]
            now = next_merges(seen, n_merges - len(merges), len(best) < line)
            if not now:
                break
            generation += 1
            read = Observation()
            index = spark.read.schema(schema).parquet(*parts)
            hit = index.where(F.col("pair").isin([tk.symbol(a) + tk.symbol(b) for a, b in now])).observe(read, F.count(F.lit(1)).alias("rows"))
            held = _live(hit).dropDuplicates(["id"])
            changed = written(held.select("id", "n", F.col("word").alias("old"), _applied(F.col("word"), now, 256 + len(merges)).alias("word")), "changed")
            if log is not None:
                log.append({"merges": len(now), "rows_read": read.get["rows"], "words": changed.count()})
            written(_rows(changed, generation).sortWithinPartitions("pair"), "index")
            parts.append(made[-1])
            pairs = written(pairs.unionByName(_differences(changed)).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > 0), "pairs")
            counted = made[-1]
            if generation % every == 0:
                written(_live(spark.read.schema(schema).parquet(*parts)).select(*schema.names).sortWithinPartitions("pair"), "index")
                parts = [made[-1]]
            merges += now
            dropped([*parts, counted])
        return merges
    finally:
        dropped([])
