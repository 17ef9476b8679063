"""Alignment of two tokenizers' tokens over the same bytes, and counts of the ids that they link.

A text is encoded by tokenizer A (byte-level BPE of the ``tokenizers`` library, on a space and the text) and
by B (a SentencePiece model, which puts the space there itself).  Each token covers a range of bytes.  The
ranges of B's tokens are a static interval index: sorted starts and ends.  A stabbing query by bisection lists
the B tokens that an A token overlaps; a gap behind an A token that the last of them doesn't span is a
border where both have a token's end.  Borders cut the tokens into groups, and link the two
tokens that end there.

Both tokenizers begin anew at a space behind a character that is no white space: A's pattern matches nothing
across it, no piece of B holds a space behind another character.  So they do between a Latin letter and an ASCII
character behind it that is no letter, where A has the byte-level pattern, whose runs of letters end there, and no
piece of B holds the two side by side; normal forms join nothing across it.  Texts are cut there, and the
alignments of short stretches are remembered, up to a fixed number.  Texts are whole.

Counts over the corpus are relational: link pairs are exploded from a table written once (a row for each document
and pair, as often as it occurs there), summed by pair with partial aggregation, and joined back to
the documents' pairs.  The table of counts is broadcast where it has at most ``broadcast_rows`` rows, counted
beforehand; beyond that both sides are shuffled by pair, and Spark splits what is skewed.  Results don't
depend on which of the two it is.

Defined results: null and empty texts have no tokens; nor have texts whose bytes A's or B's tokens don't
give back (a literal space mark, say); strings of special tokens are plain text; ids may be null or repeat, each
row is a document of its own; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import pieces, shared_table, trimmed
from fragmill.llm.piece_codec import MARK, MergeModel
from fragmill.llm.token_orc import Known, byte_alphabet

#: Rows of the table of counts up to which it is broadcast (some 60 bytes each).
BROADCAST = 2_000_000
#: Characters of a stretch up to which its alignment is remembered.
SHORT = 100
#: Stretches that are encoded together.
TOGETHER = 5_000
#: Characters that A takes at once, if there is a safe place to cut.
LONG = 50_000
_BORDER = re.compile(rf".*?[^\s{MARK}](?= )|.+", re.S)
#: Latin letters, and the ASCII characters that may end a run of them.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ENDS = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha()]
_SAFE = re.compile(r"(?<=\S)(?=[ \t-\r])")


class Intervals:
    """A static index of ranges that follow each other without gaps."""

    def __init__(self, ends: list[int]):
        self.ends, self.starts = ends, [0, *ends[:-1]]

    def stab(self, start: int, end: int) -> range:
        """The ranges that overlap [start, end)."""
        return range(bisect_right(self.ends, start), bisect_left(self.starts, end))


def borders(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int]]:
    """(A token, B token) that end together, in order."""
    index, out, start = Intervals(b_ends), [], 0
    for i, end in enumerate(a_ends):
        over = index.stab(start, end)
        if over and b_ends[over[-1]] == end:  # nothing spans the gap behind this token
            out.append((i, over[-1]))
        start = end
    return out


class Aligner:
    """The tokens of both tokenizers and their alignment, stretch by stretch."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in byte_alphabet().items()}
        vocab = self.a.get_vocab()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        self.b = MergeModel(b_path)
        self.b_bytes = dict.fromkeys(range(self.b.library.get_piece_size()), b"") | {i: p.replace(MARK, " ").encode() for i, p in self.b.text.items()} | {i: bytes([b]) for b, i in enumerate(self.b.bytes)}
        #: Stretches may only be cut where B can be.
        self.cuts = self.stretches(self.a.to_str()) if self.b.cut is not None else None
        self.known = Known(self.aligned)
        #: Ids of stretches that are not known yet, encoded together.
        self.encoded: dict[str, tuple[list[int], list[int]]] = {}

    def stretches(self, a_json: str) -> re.Pattern:
        """Matches the stretches of a text one by one."""
        settings = json.loads(a_json)
        plain = settings["normalizer"] is None and {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}.items() <= settings["pre_tokenizer"].items()
        beside = {b for p in self.b.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        ends = "".join(re.escape(c) for c in _ENDS if c not in beside)
        if not (plain and ends and len(self.b.library.encode("a")) == 1):
            return _BORDER
        # A word and a run of other characters before a space come first, being the most frequent.
        return re.compile(rf" [{_LATIN}]+(?=[ {ends}])|[{ends}]+(?= )|.*?(?:[^\s{MARK}](?= )|[{_LATIN}](?=[{ends}]))|.+", re.S)

    def a_ids(self, text: str) -> list[int]:
        ids, at = [], 0
        while len(text) - at > LONG and (found := _SAFE.search(text, at + LONG)):
            ids += self.a.encode(text[at : found.start()], add_special_tokens=False).ids
            at = found.start()
        return ids + self.a.encode(text[at:], add_special_tokens=False).ids

    def b_ids(self, text: str) -> list[int]:
        """Of a text that begins with B's space, which the library puts there itself, but not before nothing; or of one behind a letter."""
        if text[0] != " ":
            return self.b.library.encode(f"a{text}")[1:]
        if text != " ":
            return self.b.library.encode(text[1:])
        return np.frombuffer(self.b.encode_normal(MARK), np.int32).tolist()

    def encode_together(self, stretches: list[str]) -> None:
        """Encode the short ones that are not known yet by one call of each library."""
        known = self.known
        new = [x for x in set(stretches) if x not in known and len(x) <= SHORT and x != " " and x not in known.before]
        a = self.a.encode_batch_fast(new, add_special_tokens=False)
        b = self.b.library.encode([x[1:] if x[0] == " " else f"a{x}" for x in new], num_threads=1)
        self.encoded = {x: (i.ids, j if x[0] == " " else j[1:]) for x, i, j in zip(new, a, b)}

    def aligned(self, text: str) -> tuple[int, int, bytes, bytes, bool]:
        """Numbers of A and B tokens, groups as text, links as packed longs, and whether both give the bytes back."""
        a, b = self.encoded.get(text) or (self.a_ids(text), self.b_ids(text))
        a_parts, b_parts = [*map(self.a_bytes.__getitem__, a)], [*map(self.b_bytes.__getitem__, b)]
        raw = text.encode()
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return len(a), len(b), b"", b"", False
        groups, links, i, j = [], [], 0, 0
        for x, y in borders([*accumulate(map(len, a_parts))], [*accumulate(map(len, b_parts))]):
            groups.append(f"{a[i] if x == i else ','.join(map(str, a[i : x + 1]))}|{b[j] if y == j else ','.join(map(str, b[j : y + 1]))}")
            links.append(a[x] << 32 | b[y])
            i, j = x + 1, y + 1
        return len(a), len(b), ";".join(groups).encode(), array("q", links).tobytes(), True

    def document(self, text: str):
        """Numbers of tokens, groups as text, and links of a whole text."""
        if not text:
            return 0, 0, b"", b""
        known, whole = self.known, f" {text}"
        stretches, found = self.cuts.findall(whole) if self.cuts else [whole], []
        for at in range(0, len(stretches), TOGETHER):
            some = stretches[at : at + TOGETHER]
            self.encode_together(some)
            found += [known[s] if len(s) <= SHORT else self.aligned(s) for s in some]
        n_a, n_b, groups, links, whole = zip(*found)
        return (sum(n_a), sum(n_b), b";".join(groups), b"".join(links)) if all(whole) else (0, 0, b"", b"")


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``), pairs (A id * 2^32 + B id, distinct) and times (of each pair).

    A narrow map over Arrow batches.
    """

    def run(batches):
        one = aligner(a_path, b_path)
        for batch in pieces(batches, 256):
            rows = [one.document(t.as_py()) for t in batch.column(1)]
            links = [np.unique(np.frombuffer(r[3], "<i8"), return_counts=True) for r in rows]
            ends = pa.array(np.cumsum([0, *(len(x) for x, _ in links)]), pa.int32())
            flat = lambda k, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind), *(x[k] for x in links)]).astype(kind)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[3]) // 8 for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string()), flat(0, np.int64), flat(1, np.int32)],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"],
            )

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return text.mapInArrow(trimmed(run), "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>")


def _exploded(aligned: DataFrame, *keys: str) -> DataFrame:
    return aligned.select(*keys, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(*keys, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n (links in the corpus that hold the pair), best (is n the highest of the B id?)."""
    counts = _exploded(aligned).groupBy("pair").agg(F.sum("times").cast("long").alias("n"))
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "n")
    counts = shared_table(counts, "link-counts")
    highest = counts.groupBy("b_id").agg(F.max("n").alias("highest"))  # a row for each id of B's vocabulary
    return counts.join(highest, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("highest")).alias("best"))


def scores(aligned: DataFrame, broadcast_rows: int = BROADCAST) -> DataFrame:
    """The rows of ``align`` (``aligned`` is a written table, with other columns as they are) with n_links, n_best and count_sum.

    n_best: links whose count is the highest of their B id in the corpus, ties included; count_sum: of all links' counts.
    """
    rows = shared_table(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = shared_table(link_counts(rows).select("pair", "n", "best"), "link-best")
    counts = F.broadcast(counts) if counts.count() <= broadcast_rows else counts
    held = _exploded(rows, "_row").join(counts, "pair")
    sums = held.groupBy("_row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, "_row", "left").select(*[c for c in rows.columns if c not in ("_row", "pairs", "times")], *zero)
