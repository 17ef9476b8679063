"""N-gram Jaccard self-join with PartEnum signatures, and the groups its links form.

A document is the set of its distinct word shingles.  Sets fall into size bands; two sets that
link are in the same band or in neighbours, so each set signs once for its own band and, if a
larger partner may exist there, once for the next.  In band j the sizes bound the symmetric
difference by k.  The feature domain is hashed into partitions and subsets of partitions are
enumerated so that sets within k agree on one subset at least:

* k <= 3: k + 2 partitions, each subset of two of them (the pigeonholes left by k differences);
* larger k: k + 1 + e partitions, each alone; at least 1 + e of them agree.  A set signs all but its e
  lowest partitions, in order of the shingles they hold, then of their numbers.  What agrees has the same
  order in both sets, so the highest of the 1 + e is among the e lowest of neither.  Partitions of one
  shingle, which sets share by chance the more often the more sets there are, are so left out mostly.

A signature is the 64-bit sum of a subset's hashed shingles.  So no link can be missed.

Steps: sets with equal fingerprints are one class, whose copies never meet each other.
Signatures are dealt by value; a class with equal signatures is compared to the smallest of the
bucket only (a star): first by size and a histogram, whose distance bounds the difference
from below, then exactly.  Verified links join classes into components.  Buckets that still hold
several components are then compared fully across components, but in blocks of a bounded size.
In a bucket of few classes a bound from histograms drops pairs inside the worker before any row is made;
what is left is verified exactly.  Verification takes texts again, and a class with many
partners is salted.  Blocks of a crowded bucket bring the texts along and are verified inside the worker:
only links between parts of the block that no link has joined yet become rows, fewer than the block has classes.

Shingles are compared by 64-bit hashes of whole words, classes by 64-bit fingerprints.

Defined results: null, empty or word-less texts have no shingles, and are linked with nothing,
not even each other; fewer words than a shingle: the whole sequence is one shingle; repeated
rows and ids are kept, ids that repeat form one component by their texts; a null id is never
the smallest, and a component of null ids alone has a null id; texts that only null ids have
link like any other; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import _ODD, drop_shared, fresh, mix, pieces, release_shuffles, sequence_hashes, shared_table, trimmed
from fragmill.llm.components import components

#: Bins of the histograms that bound a difference from below, at least.
BINS = 64
#: Classes of a bucket that one block of the full comparison holds, and partners of one salt.
BLOCK, SALT = 1024, 256
#: Classes beyond which a bucket is crowded, and shingles that one block of such a bucket holds, about.
CROWD, ROOM = 32, 4_000_000
#: Rows of a block up to which its pairs are taken one by one.
FEW = 12
#: Pairs of the full comparison that a batch holds.
PAIRS = 50_000
#: Bytes of texts that are hashed together.
TOGETHER = 1_000_000
#: One partition is spare for so many differences.
SPARE = 5
#: Signatures of a class that tell whether an earlier bucket has compared a pair.
FIRSTS = 24

#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 64

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Masks of the first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def shingles(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    return next(shingle_sets(pa.array([text.encode() if isinstance(text, str) else text], pa.binary()), words))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """``shingles`` of each text of a column, hashed together, some texts at a time."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, "right")) - 1)
        bounds = offsets[at : end + 1] - offsets[at]
        raw = np.concatenate([_LOWER[data[offsets[at] : offsets[end]]], np.zeros(8, np.uint8)])
        inside = np.concatenate([[False], ~_SPACES[raw[:-8]], [False]])
        opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        filled = bounds[:-1][bounds[1:] > bounds[:-1]]  # no word goes on in the next text
        opens[filled], closes[filled[1:] - 1] = inside[1 + filled], inside[filled[1:]]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        h = _word_hashes(raw, start, stop)
        every, of = sequence_hashes(h, words), np.searchsorted(start, bounds).tolist()
        for a, b in zip(of, of[1:]):
            yield distinct(every[a : b - words + 1] if b - a >= words else sequence_hashes(h[a:b], max(1, b - a)))
        at = end


def _word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words raw[start:stop], eight bytes after eight; ``raw`` has eight bytes more.  Long words by themselves."""
    size = stop - start
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = mix(size.astype(np.uint64))
    for k in range(0, min(int(size.max(initial=0)), LONG_WORD), 8):
        i = np.flatnonzero(size > k)
        h[i] = mix(h[i] * _ODD + (eights[start[i] + k] & _FIRST[np.minimum(size[i] - k, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : stop[i]].tobytes())
    return h


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique hashes integers, which takes longer than sorting them."""
    s = np.sort(s)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def fingerprint(s: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(s))]) + _U(len(s))).view(np.int64)[0])


@functools.lru_cache(maxsize=64)
def bands(percent: int, most: int = 1 << 40) -> tuple[int, ...]:
    """Largest size of each band; a partner of a set is at most one band above it."""
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
    return tuple(tops)


def difference(sizes: int, percent: int) -> int:
    """The largest symmetric difference of linked sets whose sizes sum up to ``sizes``."""
    return (100 - percent) * sizes // (100 + percent)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """All PartEnum signatures of a set."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    tops = bands(percent)
    own = int(np.searchsorted(tops, n))
    hashed = mix(s)
    out = []
    for tag in (own, own + 1) if n * 100 // percent > tops[own] else (own,):
        k = difference(2 * tops[tag], percent)
        if k == 0:
            cells = np.array([np.add.reduce(hashed)])
        elif k <= 3:
            sums = _cells(hashed, k + 2)[0]
            i, j = np.array(list(itertools.combinations(range(k + 2), 2))).T
            cells = sums[i] * _U(3) + mix(sums[j])
        else:
            spare = max(1, k // SPARE)
            sums, filled = _cells(hashed, k + 1 + spare)
            keep = np.argsort(filled, kind="stable")[spare:]
            out.append(mix(sums[keep] + mix(keep.astype(np.uint64) + _U(tag << 32))))
            continue
        out.append(mix(cells + mix(np.arange(len(cells), dtype=np.uint64) + _U(tag << 32))))
    return np.concatenate(out)


def _cells(hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = ((hashed >> _U(32)) % _U(n)).astype(np.int64)
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, at, hashed)
    return sums, np.bincount(at, minlength=n)


def histogram(s: np.ndarray) -> bytes:
    """Shingles by bin, a byte each; the bins of two sets differ by no more than the sets.

    At four shingles a bin even sets that share half of their content show the difference.
    """
    bins = BINS
    while bins * 4 < len(s):
        bins *= 2
    return np.minimum(np.bincount(((mix(s) >> _U(7)) % _U(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def folded(bins: bytes, n: int) -> np.ndarray:
    """The histogram in ``n`` bins, a power of two that is no more than it has."""
    return np.frombuffer(bins, np.uint8).reshape(-1, n).sum(axis=0, dtype=np.int32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(words: int, percent: int):
    """doc_id, text, text_key -> a row for the document, and the signatures of each class of the batch."""

    def run(batches):
        rows = 0
        for batch in pieces(batches):
            ids = batch.column(0)
            seen, sizes, fps, sigs, owners = set(), [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                fp = fingerprint(s) if len(s) else None
                sizes.append(len(s))
                fps.append(fp)
                if fp is not None and fp not in seen:
                    seen.add(fp)
                    sigs.append(signatures(s, percent).view(np.int64))
                    owners.append(np.full(len(sigs[-1]), fp))
            n = len(sizes)
            rows += n
            spread = mix(np.arange(rows - n, rows, dtype=np.uint64)).view(np.int64)  # rows of documents go anywhere
            sig = np.concatenate([spread, *sigs])
            fp = pa.concat_arrays([pa.array(fps, pa.int64()), pa.array(np.concatenate(owners) if owners else [], pa.int64())])
            rest = len(sig) - n
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig), fp, pa.concat_arrays([ids, pa.nulls(rest, pa.int64())]), pa.concat_arrays([batch.column(2), pa.nulls(rest, pa.int64())]), pa.array(np.concatenate([sizes, np.full(rest, -1)]).astype(np.int32))],
                names=["sig", "fp", "doc_id", "text_key", "n"],
            )

    return run


def _buckets(batches):
    """Rows sorted by (sig, fp) -> rows of documents, and (sig, leader, fp) of shared signatures.

    Memory holds a batch; a bucket that goes on in the next one is carried as its signature,
    leader and last class.
    """
    names = ["sig", "leader", "fp", "doc_id", "text_key", "n"]
    last = None  # (sig, leader, last fp, leader written)
    for batch in batches:
        n = batch.column(4).to_numpy()
        docs = n >= 0
        out = [[np.zeros(0, np.int64)] * 3]
        d = batch.filter(pa.array(docs))
        sig, fp = (batch.column(i).filter(pa.array(~docs)).to_numpy() for i in (0, 1))
        if len(sig):
            first = np.concatenate([[True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])])
            if last and sig[0] == last[0] and fp[0] == last[2]:
                first[0] = False
            sig, fp = sig[first], fp[first]
        if len(sig):
            start = np.concatenate([[True], sig[1:] != sig[:-1]])
            lead = fp[np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))].copy()
            count = np.diff(np.concatenate([np.flatnonzero(start), [len(sig)]]))
            shared = np.repeat(count > 1, count)
            if last and sig[0] == last[0]:
                lead[: count[0]] = last[1]
                shared[: count[0]] = True
                if not last[3]:
                    out.append([np.array([last[0]]), np.array([last[1]]), np.array([last[1]])])
                written = True if count[0] == len(sig) else bool(shared[-1])
            else:
                written = bool(shared[-1])
            out.append([sig[shared], lead[shared], fp[shared]])
            last = (sig[-1], lead[-1], fp[-1], written)
        made = [np.concatenate(x) for x in zip(*out)]
        m = len(made[0])
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.nulls(len(d), pa.int64()), pa.array(made[0], pa.int64())]),
                pa.concat_arrays([pa.nulls(len(d), pa.int64()), pa.array(made[1], pa.int64())]),
                pa.concat_arrays([d.column(1), pa.array(made[2], pa.int64())]),
                pa.concat_arrays([d.column(2), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([d.column(3), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([d.column(4), pa.nulls(m, pa.int32())]),
            ],
            names=names,
        )


def _verified(words: int, percent: int):
    """(leader, salt, kind, fp, text) in order, kind 0 the leader itself -> links."""

    def run(batches):
        now, own = None, None
        for batch in pieces(batches):
            out = []
            leader, salt, kind, fp = (batch.column(i).to_pylist() for i in range(4))
            for i, s in enumerate(shingle_sets(batch.column(4), words)):
                if kind[i] == 0:
                    now, own = (leader[i], salt[i]), s
                elif now == (leader[i], salt[i]) and linked(own, s, percent):
                    out.append((leader[i], fp[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link; ``texts``: fp, text."""
    many = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    salts = many.select("a", F.ceil(F.col("partners") / SALT).cast("int").alias("salts"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = salted.select(F.col("a").alias("leader"), "salt", F.lit(1).alias("kind"), F.col("b").alias("fp"))
    leaders = salts.select(F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("fp"))
    rows = members.unionByName(leaders).join(texts.select("fp", "text"), "fp").select("leader", "salt", "kind", "fp", "text")
    dealt = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind")
    return dealt.mapInArrow(trimmed(_verified(words, percent)), "a long, b long")


def _close(percent: int):
    def run(batches):
        for batch in pieces(batches):
            size_a, size_b, bins_a, bins_b = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = []
            for m, n, x, y in zip(size_a, size_b, bins_a, bins_b):
                ok = min(m, n) * 100 >= max(m, n) * percent
                if ok:
                    k = min(len(x), len(y))
                    ok = int(np.abs(folded(x, k) - folded(y, k)).sum()) <= difference(m + n, percent)
                keep.append(ok)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def bounded(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and histograms do not rule a link out."""
    sides = [texts.select(F.col("fp").alias(c), F.col("size").alias(f"size_{c}"), F.col("bins").alias(f"bins_{c}")) for c in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "size_a", "size_b", "bins_a", "bins_b")
    return rows.mapInArrow(trimmed(_close(percent)), "a long, b long")


def _across(percent: int):
    """Blocks in order (sig, i, j) -> pairs of different components that the bounds leave.

    Near copies share most signatures.  Each row brings the smallest signatures of its class, and
    a pair that shares a smaller one than the bucket's is left to that bucket.
    """

    def few_pairs(sig, rows):
        """``pairs`` of a small block: histograms, which cost most, come last."""
        smaller, a, b = [{s for s in r[5] if s < sig} for r in rows], [], []
        for i, (side, fp, root, size, bins, _) in enumerate(rows):
            if side == 1:
                continue
            for j, (other, fp_j, root_j, size_j, bins_j, _) in enumerate(rows):
                if other == 0 or root_j == root or (side == 2 and fp_j <= fp):
                    continue
                if min(size, size_j) * 100 < max(size, size_j) * percent or not smaller[i].isdisjoint(smaller[j]):
                    continue
                k = min(len(bins), len(bins_j))
                if int(np.abs(folded(bins, k) - folded(bins_j, k)).sum()) <= difference(size + size_j, percent):
                    a.append(min(fp, fp_j))
                    b.append(max(fp, fp_j))
        if a:
            yield np.array(a), np.array(b)

    def pairs(sig, rows):
        """Arrays (a, b) of the pairs of a block, some rows of it at a time."""
        if len(rows) <= FEW:
            yield from few_pairs(sig, rows)
            return
        side, fp, root, size = (np.array([r[k] for r in rows]) for k in range(4))
        few = min(len(r[4]) for r in rows)
        bins = np.array([folded(r[4], few) for r in rows])
        smaller = [{s for s in r[5] if s < sig} for r in rows]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        for i in left:
            js = right[(root[right] != root[i]) & ((side[i] == 0) | (fp[right] > fp[i]))]
            js = js[np.minimum(size[js], size[i]) * 100 >= np.maximum(size[js], size[i]) * percent]
            if len(js):
                far = np.abs(bins[js] - bins[i]).sum(axis=1)
                js = js[far <= (100 - percent) * (size[js] + size[i]) // (100 + percent)]
                js = np.array([j for j in js if smaller[i].isdisjoint(smaller[j])], np.int64)
                if len(js):
                    yield np.minimum(fp[js], fp[i]), np.maximum(fp[js], fp[i])

    def in_batches(blocks):
        """A batch whenever PAIRS pairs are there, so that memory holds no more, however many a block has."""
        found, n = [], 0
        for sig, rows in blocks:
            for a, b in pairs(sig, rows):
                found.append((a, b))
                n += len(a)
                if n >= PAIRS:
                    yield _pair_batch(found)
                    found, n = [], 0
        yield _pair_batch(found)

    return lambda batches: in_batches(_blocks(batches))


def _blocks(batches, last=None):
    """Rows in order (sig, i, j) -> sig and the other columns of each block of several rows; ``last`` maps a batch to what replaces its last column."""
    now, rows = None, []
    for piece in pieces(batches):
        columns = [piece.column(i).to_pylist() for i in range(piece.num_columns - (last is not None))]
        for r in zip(*columns, *([last(piece)] if last else [])):
            if r[:3] != now:
                if len(rows) > 1:
                    yield now[0], rows
                now, rows = r[:3], []
            rows.append(r[3:])
    if len(rows) > 1:
        yield now[0], rows


def _forest(words: int, percent: int):
    """Blocks in order (sig, i, j), which bring texts -> links that join all classes of a block that links inside it join.

    Pairs that roots or earlier links of the block have joined are not looked at again.
    """

    def links(sig, rows):
        side, fp, root, size = (np.array([r[k] for r in rows]) for k in range(4))
        few = min(len(r[4]) for r in rows)
        bins = np.array([folded(r[4], few) for r in rows])
        smaller = [{s for s in r[5] if s < sig} for r in rows]
        part = np.unique(root, return_inverse=True)[1]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        for i in left:
            js = right[(part[right] != part[i]) & ((side[i] == 0) | (fp[right] > fp[i]))]
            js = js[np.minimum(size[js], size[i]) * 100 >= np.maximum(size[js], size[i]) * percent]
            js = js[np.abs(bins[js] - bins[i]).sum(axis=1) <= (100 - percent) * (size[js] + size[i]) // (100 + percent)]
            for j in js.tolist():
                if part[j] != part[i] and smaller[i].isdisjoint(smaller[j]) and linked(rows[i][6], rows[j][6], percent):
                    part[part == part[j]] = part[i]
                    yield min(fp[i], fp[j]), max(fp[i], fp[j])

    def run(batches):
        for sig, rows in _blocks(batches, lambda piece: shingle_sets(piece.column(9), words)):
            made = list(links(sig, rows))
            yield _pair_batch([tuple(np.array(x) for x in zip(*made))] if made else [])

    return run


def _pair_batch(found):
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _dealt(members: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """Rows (sig, fp, root, blocks) as those of each pair of blocks of their bucket, in order; ``more``: columns of ``texts`` to bring along."""
    firsts = members.groupBy("fp").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRSTS).alias("firsts"))  # as many as a set has
    cells = members.join(texts.select("fp", "size", "bins", *more), "fp").join(firsts, "fp").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cells = cells.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "fp", "root", "size", "bins", "firsts", *more)
    return cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")


def groups(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, fp of each row; fp, root, component_id of each class)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))
    signed = text.mapInArrow(trimmed(_signed(words, percent)), "sig long, fp long, doc_id long, text_key long, n int")
    dealt = signed.repartition("sig").sortWithinPartitions("sig", "fp")
    table = shared_table(dealt.mapInArrow(_buckets, "sig long, leader long, fp long, doc_id long, text_key long, n int"), "jaccard-buckets")
    del signed, dealt
    release_shuffles(spark)
    rows = table.where("sig IS NULL").select("doc_id", "text_key", "fp", F.col("n").cast("long").alias("n_shingles"))
    buckets = table.where("sig IS NOT NULL").select("sig", "leader", "fp")

    stars = shared_table(buckets.where("leader <> fp").select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct(), "jaccard-stars")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")  # null ids last
    classes = rows.where("fp IS NOT NULL").groupBy("fp").agg(first)
    wanted = stars.select(F.col("a").alias("fp")).union(stars.select(F.col("b").alias("fp"))).distinct().join(classes, "fp").select("fp", "first.*")
    # A class is looked up by the id and text of its first document; a null id's text may be there many times.
    texts = text.join(wanted.where("NOT none").drop("none"), ["doc_id", "text_key"]).select("fp", "text")
    nameless = text.where("doc_id IS NULL").join(wanted.where("none").select("fp", "text_key"), "text_key").groupBy("fp").agg(F.min("text").alias("text"))
    texts = shared_table(texts.unionByName(nameless).mapInArrow(trimmed(_own_text(words)), "fp long, text string, size int, bins binary"), "jaccard-texts")
    release_shuffles(spark)
    likely = shared_table(bounded(stars, texts, percent), "jaccard-likely")
    links = shared_table(verify(likely, texts, words, percent), "jaccard-links")
    drop_shared(spark, likely)
    release_shuffles(spark)

    roots = shared_table(components(links), "jaccard-roots")
    placed = buckets.join(roots, buckets["fp"] == roots["node"], "left").select("sig", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high")
    mixed = shared_table(placed.join(mixed.select("sig", "m"), "sig"), "jaccard-mixed")
    release_shuffles(spark)
    if not mixed.isEmpty():
        # A pair that shares a bucket of each kind may be left to either: both compare it.
        blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / ROOM)).cast("int")
        crowds = mixed.where(F.col("m") > CROWD).join(texts.select("fp", "size"), "fp").groupBy("sig").agg(F.count("*").alias("m"), F.sum("size").alias("shingles"))
        crowds = mixed.drop("m").join(crowds.select("sig", blocks.alias("blocks")), "sig")
        found = shared_table(_dealt(crowds, texts, "text").mapInArrow(trimmed(_forest(words, percent)), "a long, b long"), "jaccard-links")
        release_shuffles(spark)
        few = mixed.where(F.col("m") <= CROWD).select("sig", "fp", "root", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        more = _dealt(few, texts).mapInArrow(trimmed(_across(percent)), "a long, b long").distinct()
        tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = shared_table(more.join(tried, ["a", "b"], "left_anti"), "jaccard-across")
        release_shuffles(spark)
        verified = shared_table(verify(more, texts, words, percent), "jaccard-links")
        if not (found.isEmpty() and verified.isEmpty()):
            links = shared_table(links.unionByName(found).unionByName(verified), "jaccard-links")
            roots = shared_table(components(links), "jaccard-roots")
        drop_shared(spark, more, found, verified)
    drop_shared(spark, texts, mixed, stars, links)
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("kept"))
    named = shared_table(named.join(smallest, "root").select("fp", "root", F.col("kept.doc_id").alias("component_id"), F.col("kept.text_key").alias("kept_key")), "jaccard-components")
    drop_shared(spark, roots)
    return rows, named


def join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) of each row of ``docs``."""
    rows, named = groups(docs, words, percent, id_col, text_col)
    return rows.join(named, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _own_text(words: int):
    """Rows (fp, text) whose text belongs to the class, one for each class of the batch, with size and histogram."""

    def run(batches):
        for batch in pieces(batches):
            seen, keep, size, bins = set(), [], [], []
            for fp, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words)):
                ok = fp not in seen and bool(len(s)) and fingerprint(s) == fp
                keep.append(ok)
                if ok:
                    seen.add(fp)
                    size.append(len(s))
                    bins.append(histogram(s))
            own = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(size, pa.int32()), pa.array(bins, pa.binary())], names=["fp", "text", "size", "bins"])

    return run


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id, null ids counting as the largest.

    Texts without words are in no group and stay; rows that repeat the kept id and text are the
    same document and stay with it; of rows that repeat an id with other texts the others go.  All
    columns stay, whatever their names; an empty table gives an empty result.
    """
    rows, named = groups(docs, words, percent, id_col, text_col)
    keep, key = fresh(docs, "keep", "keep_key")
    wordless = rows.where("fp IS NULL").select(F.col("doc_id").alias(keep), F.col("text_key").alias(key)).distinct()
    stay = named.select(F.col("component_id").alias(keep), F.col("kept_key").alias(key)).distinct().unionByName(wordless)
    same = docs[id_col].cast("long").eqNullSafe(F.col(keep)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(key))
    return docs.join(stay, same, "left_semi")
