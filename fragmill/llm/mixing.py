"""Mix sources to target weights, block by block.

Words of a source are packed into blocks of a fixed length, in a pseudorandom order of its
documents.  A target of words becomes a number of block slots for each source.  Each output
shard then draws its source counts from the multinomial law given these totals, so that every source
comes out at its target: a keyed permutation deals the slots of all sources to shards, and
only the counts by shard and source are kept.  The slots follow from the counts: shard by shard a source
takes its next indexes, another keyed permutation maps the q-th index of a source to a block, so a
block repeats only after the whole source was used, and a third one shuffles the slots of a shard.
Slots and packed blocks meet in an equi-join on (source, block).

No step orders or counts a whole source, all sources or all shards in one task: running sums go by parts
first and by part totals second, slots come from chunks, and blocks of a hot source are many keys.
DataFrame and SQL functions only.

Defined results: null text has size 0 and takes nothing; null source is a source of its own,
the last; repeated rows are separate documents of equal size; empty table, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fragmill.llm.common import SPACE, count_words, shared_table

#: Rounds of the keyed permutations.
ROUNDS = 20


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A keyed permutation of 0..n-1 by swap-or-not: each round may swap x with K - x (mod n)."""

    def turn(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - acc, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(acc, other)), F.lit(2)) == 1, other).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), turn)


def running(df: DataFrame, value: Column, to: str, part: str, order: list, *by: str) -> DataFrame:
    """Add ``to``: the sum of ``value`` over the rows before, by ``by``, in order of ``part``, then ``order``.

    One task sees the rows of one part; above that there is a row for each part.
    """
    totals = df.groupBy(*by, part).agg(F.sum(value).alias("_total"))
    parts = W.partitionBy(*by).orderBy(part) if by else W.orderBy(part)
    base = totals.select(*[F.col(c).alias(f"_{c}") for c in (*by, part)], (F.sum("_total").over(parts.rowsBetween(W.unboundedPreceding, 0)) - F.col("_total")).alias("_base"))
    inner = W.partitionBy(*by, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_before", F.sum(value).over(inner) - value)
    same = F.lit(True)
    for c in (*by, part):
        same &= F.col(c) == F.col(f"_{c}")
    return rows.join(base, same).withColumn(to, F.col("_before") + F.col("_base")).select(*df.columns, to)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, part, source_no, source_size, target: words by weight, none above ``most`` times its size.

    Sources fill like vessels: what those that are full can't take is shared by the others' weights,
    again and again until none is above.  Parts are ranges of sources, in order of their numbers.
    """
    order = F.col("source").asc_nulls_last()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = shared_table(per.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    per = running(per, F.lit(1), "source_no", "part", [order])
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int")))
    per = shared_table(per.withColumn("cap", most * F.col("source_size")), "mix-weights")
    level, before = 0.0, None
    while level != before:  # one row a round; a source that is full stays so
        above = F.col("cap") < level * F.col("weight")
        sums = per.agg(F.sum("source_size").alias("size"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        before, level = level, (share * sums["size"] - sums["full"]) / sums["open"] if sums["open"] else level
    return per.select("source", "part", "source_no", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def pack(sizes: DataFrame, block_words: int, seed: int, part_rows: int = 20_000) -> DataFrame:
    """Where each document lies: source_no, block, row_id, first word and words in that block."""
    parts = max(1, sizes.count() // part_rows + 1)
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = sizes.where("size > 0").select("row_id", "doc_id", "source_no", "size", order.alias("o"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.lit(parts)).alias("part"))
    inner = W.partitionBy("source_no", "part").orderBy("o", "doc_id", "size", "row_id").rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    base = totals.withColumn("base", F.sum("words").over(W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    placed = rows.withColumn("start", F.sum("size").over(inner) - F.col("size")).join(base.drop("words"), ["source_no", "part"]).withColumn("start", F.col("start") + F.col("base"))
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    cells = placed.select("source_no", "row_id", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return cells.select("source_no", "block", "row_id", (lo - F.col("start")).alias("offset"), (hi - lo).alias("words"))


def draw(goal: DataFrame, block_words: int, shard_slots: int, seed: int, chunk: int = 10_000) -> tuple[DataFrame, int]:
    """(shard, source_no, blocks, n, q: the source counts of each shard and the first index they take; slots of all shards)."""
    size, target = F.col("source_size"), F.col("target")
    plan = goal.where("source_size > 0").withColumn("blocks", F.ceil(size / block_words))
    whole = F.floor(target / size)
    plan = plan.withColumn("n_slots", whole * F.col("blocks") + F.least(F.round((target - whole * size) / block_words).cast("long"), F.col("blocks") * F.when(whole >= 2, 0).otherwise(1)))
    plan = running(plan, F.col("n_slots"), "first", "part", ["source_no"])
    every = int(plan.agg(F.sum("n_slots")).first()[0] or 0)
    chunks = plan.where("n_slots > 0").withColumn("c", F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {chunk})")))
    # As many tasks as asked for: the plan takes so small a table for one task's work.
    chunks = chunks.repartition(int(goal.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "c")
    each = chunks.withColumn("k", F.explode(F.expr(f"sequence(c * {chunk}, least((c + 1) * {chunk}, n_slots) - 1)")))
    at = permuted(F.col("first") + F.col("k"), F.lit(max(every, 1)), F.lit(seed))
    counts = each.withColumn("p", at).select("source_no", "blocks", F.expr(f"p div {shard_slots}").alias("shard"))
    counts = shared_table(counts.groupBy("shard", "source_no", "blocks").agg(F.count("*").alias("n")).withColumn("span", F.expr("shard div 1024")), "mix-draws")
    return running(counts, F.col("n"), "q", "span", ["shard"], "source_no").drop("span"), every


def slots(drawn: DataFrame, every: int, shard_slots: int, seed: int) -> DataFrame:
    """The mix: shard, slot, source_no, block, epoch, from the counts that the shards have drawn."""
    by_source = W.partitionBy("shard").orderBy("source_no").rowsBetween(W.unboundedPreceding, 0)  # no more rows than a shard has slots
    placed = drawn.withColumn("offset", F.sum("n").over(by_source) - F.col("n"))
    placed = placed.repartition(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "source_no")
    each = placed.select("shard", "source_no", "blocks", "offset", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).withColumn("q", F.col("q") + F.col("i"))
    here = F.least(F.lit(shard_slots), F.lit(every) - F.col("shard") * shard_slots)
    slot = permuted(F.col("offset") + F.col("i"), here, F.xxhash64(F.lit(seed + 2), "shard"))
    block = permuted(F.expr("q % blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "source_no"))
    return each.select("shard", slot.alias("slot"), "source_no", block.alias("block"), F.expr("q div blocks").alias("epoch"))


def plan(sizes: DataFrame, block_words: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes with targets, drawn counts, slots, packed) for a written table of row_id, doc_id, source, size."""
    goal = shared_table(targets(sizes), "mix-targets")
    sized = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).select(sizes["*"], "source_no", "source_size", "target")
    sized = shared_table(sized, "mix-sized")
    drawn, every = draw(goal, block_words, shard_slots, seed)
    return sized, drawn, slots(drawn, every, shard_slots, seed), pack(sized, block_words, seed)


# Sizes of tables made from the few rows of ``targets`` are guessed far too low, so the joins
# below ask for a sort-merge join: a broadcast of slots or blocks would grow with the corpus.


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64, shard_slots: int = 8192, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents with targets and taken words, slots of the mix, packed blocks, source counts that the shards drew)."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"))
    # Writing fixes the ids of rows; they only join, and order nothing but rows alike in id and size.
    sizes = shared_table(sizes.withColumn("row_id", F.monotonically_increasing_id()), "mix-sizes")
    sized, drawn, mixed, packed = plan(sizes, block_words, shard_slots, seed)
    times = mixed.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = packed.hint("merge").join(times, ["source_no", "block"]).groupBy("row_id").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = sized.hint("merge").join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "source_no", "row_id")
    return out, mixed, packed, drawn


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64, shard_slots: int = 8192, seed: int = 17) -> DataFrame:
    """The mix as documents: a row for each document and epoch with the words taken there.

    A document taken whole keeps its text as it is; of one taken in part, the taken words
    follow each other, joined by one space.  All columns stay; ``n_chars``, where there is one, is
    renewed.  Null, empty and word-less texts are not in the mix; null source is a source of its own,
    the last; rows that repeat are documents of their own; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"))
    stored = shared_table(rows.withColumn("row_id", F.monotonically_increasing_id()), "mix-rows")
    _, _, mixed, packed = plan(stored.select("row_id", "doc_id", "source", "size"), block_words, shard_slots, seed)
    picks = packed.hint("merge").join(mixed, ["source_no", "block"]).groupBy("row_id", "epoch").agg(F.sort_array(F.collect_list(F.struct("offset", "words"))).alias("cells"), F.sum("words").alias("taken"))
    out = stored.hint("merge").join(picks, "row_id")
    words = F.filter(F.split(F.col("row")[text_col], f"{SPACE}+"), lambda w: w != "")
    part = F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("cells", lambda c: F.slice(w, (c["offset"] + 1).cast("int"), c["words"].cast("int")))), " ")), 1)
    text = F.when(F.col("taken") == F.col("size"), F.col("row")[text_col]).otherwise(part)
    out = out.select("row", text.alias("text"))
    renewed = {text_col: F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[(F.col("row")[c] if c not in renewed else renewed[c]).alias(c) for c in docs.columns])
