"""SentencePiece encoding (models of merge type) and decoding.

A model of merge type starts from single characters and joins, again and again, the two neighbours
whose concatenation is the piece with the highest score, the leftmost such pair first.  The same pieces
are found here without a queue of merges, by backtracking:

* Aho-Corasick automata give longest matches: the trie of one over the pieces the longest at a place; in long segments
  this automaton gives those that follow each other, and, where these don't do, one over the reversed pieces the
  longest at each place in a pass over the reversed text.
  Shorter ones follow by a table of each piece's prefixes.
* A sequence of pieces is the model's if and only if each two neighbours are compatible: merging their
  characters anew gives the same two.  (The first merge across a border of the sequence would also
  come first in the text of the two neighbours alone.)  Answers are remembered, up to a fixed number.
* From left to right the longest piece that is compatible with the one before is taken.  Where none is, the
  place is marked in a bitfield of failed places, the last piece is taken back and a shorter one tried there;
  no piece may end at a failed place again, so the work is linear in the text.

Characters that no piece has are units that join with nothing; their UTF-8 bytes become byte pieces.
Where no piece holds the space mark behind another character, pieces never cross the border between a
character and a space mark; nor do they cross the border of a character that is in no piece of several, nor,
where no piece holds a letter beside another character, that of a run of letters.
The text is cut there, and the pieces of segments are remembered, up to a fixed number.

Encoding and decoding are narrow maps over Arrow batches: no shuffle, and a lost executor only repeats its own
partitions.

Defined results: null or empty text has no ids and decodes to an empty text; texts are whole, however
long, and a segment without a space mark takes a few bytes a character; repeated rows are kept; strings of
control pieces in a text are plain text; a literal space mark decodes as a space, as in the library; an
empty table stays empty; other columns pass through, and a column with the output's name is replaced.
"""

from __future__ import annotations

import functools
import re
from array import array
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fragmill.llm.bpe_codec import _schema, _with
from fragmill.llm.common import pieces, trimmed
from fragmill.llm.token_orc import Known

#: The character that stands for a space in pieces.
MARK = "▁"
#: Characters of a segment up to which its ids are remembered.
SHORT = 100

class Segments(Known):
    """The packed ids of segments; long ones are not remembered."""

    def __missing__(self, segment: str) -> bytes:
        return super().__missing__(segment) if len(segment) <= SHORT else self.make(segment)


class MergeModel:
    """Pieces and scores of a model file, and encoding by backtracking.

    Units are ids of pieces, or -1 - the code point of a character that no piece is.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.text = {i: p for p, i in self.ids.items()}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.byte_fallback = all(sp.is_byte(i) for i in self.bytes)
        # A piece that its own characters don't merge to is never in a result.
        reached = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.reached = {p: self.ids[p] for p in reached}
        self.size = {self.ids[p]: len(p) for p in reached}
        self.forward, self.reversed = ahocorasick.Automaton(ahocorasick.STORE_INTS), ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in reached:
            self.forward.add_word(p, self.ids[p])
            self.reversed.add_word(p[::-1], self.ids[p])
        self.forward.make_automaton()
        self.reversed.make_automaton()
        #: piece -> the longest other piece that it begins with, None if none.
        self.shorter = {self.ids[p]: next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reached), None) for p in reached}
        #: each beginning of a piece, a node of the trie -> the longest piece that it begins with, -1 if none.
        self.begins = {"": -1}
        for p in sorted(reached):  # a beginning comes before what it begins
            for k in range(1, len(p) + 1):
                if p[:k] not in self.begins:
                    self.begins[p[:k]] = self.reached.get(p[:k], self.begins[p[: k - 1]])
        self.inside = {p[i : i + 2] for p in reached for i in range(len(p) - 1)}
        self.histories = Known(self.history)
        self.compatible = Known(self.remerged)
        joined = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        self.cut = None
        if not any(MARK in p.lstrip(MARK) for p in self.ids):
            inner = "".join(map(re.escape, sorted(joined)))
            letters = "".join(map(re.escape, sorted(c for c in joined if c.isalpha())))
            others = "".join(map(re.escape, sorted(c for c in joined if not c.isalpha())))
            runs = [letters, others] if self.apart() else [inner]
            self.cut = re.compile("|".join([*(f"{MARK}*[{c}]+" for c in runs if c), f"{MARK}+", f"[^{MARK}{inner}]+"]))
        self.segments = Segments(self.packed)

    def apart(self) -> bool:
        """Does no piece hold a letter beside a character that is neither a letter nor the space mark?"""
        return all(a == MARK or b == MARK or a.isalpha() == b.isalpha() for p in self.ids for a, b in zip(p, p[1:]))

    def unit(self, u: int) -> str:
        return self.text[u] if u >= 0 else chr(-1 - u)

    def remerged(self, pair: tuple[int, int]) -> bool:
        """Do the characters of two units merge to the same two?

        Each unit's own merges are replayed side by side, the better first, the left one of equals; a merge across the
        border that is better than what either does next would come before them.
        """
        if min(pair) < 0:
            left, right = map(self.unit, pair)
            return left[-1] + right[0] not in self.inside or self.merged(left + right) == [left, right]
        (mine, _, ends), (other, starts, _) = self.histories[pair[0]], self.histories[pair[1]]
        if ends[0] + starts[0] not in self.inside:  # no piece has the two characters at the border side by side
            return True
        i = j = 0
        while True:
            across = self.scores.get(ends[i] + starts[j])
            if across is not None and across > mine[i] and across >= other[j]:
                return False
            if mine[i] == other[j] == -inf:
                return True
            if mine[i] >= other[j]:
                i += 1
            else:
                j += 1

    def history(self, t: int) -> tuple[list[float], list[str], list[str]]:
        """The scores of a piece's merges, and its first and last part before each and after all."""
        parts, done, first, last = list(self.text[t]), [], [], []
        while True:
            first.append(parts[0])
            last.append(parts[-1])
            scores = [self.scores.get(a + b, -inf) for a, b in zip(parts, parts[1:])]
            done.append(max(scores, default=-inf))
            if done[-1] == -inf:
                return done, first, last
            i = scores.index(done[-1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, the definition that all else must agree with."""
        parts = list(text)
        scores = [self.scores.get(a + b) for a, b in zip(parts, parts[1:])]
        while (best := max((s for s in scores if s is not None), default=None)) is not None:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = self.scores.get(parts[i - 1] + parts[i])
            if i < len(scores):
                scores[i] = self.scores.get(parts[i] + parts[i + 1])
        return parts

    def longest(self, text: str) -> array:
        """The longest piece that starts at each place; -1 where there is none."""
        out, last, size = array("i", [-1]) * len(text), len(text) - 1, self.size
        for end, t in self.reversed.iter(text[::-1]):
            at = last - end
            if out[at] < 0 or size[t] > size[out[at]]:
                out[at] = t
        return out

    def units(self, text: str) -> array:
        """The units of a text: the longest each, and back where no piece is compatible."""
        n, size, compatible, shorter, begins = len(text), self.size, self.compatible, self.shorter, self.begins
        taken = array("i")
        at, before, t = 0, None, None
        longest = None
        if n > SHORT:
            for end, found in self.forward.iter_long(text):  # longest matches, one behind the other, as long as they fit
                if end + 1 - size[found] != at or (before is not None and not compatible[before, found]):
                    break
                taken.append(found)
                at, before = end + 1, found
            if at == n:
                return taken
            longest = self.longest(text)
        in_trie = self.forward.longest_prefix
        failed = None  # a bit for each place, once there is one
        while at < n:
            if t is None:
                if longest is not None:
                    t = longest[at]
                else:
                    rest = text[at:]
                    t = begins[rest[: in_trie(rest)]]
                if t < 0:
                    t = -1 - ord(text[at])
            while t is not None:
                end = at + (size[t] if t >= 0 else 1)
                if (before is None or compatible[before, t]) and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                    break
                t = shorter[t] if t >= 0 else None
            if t is not None:
                taken.append(t)
                at, before, t = end, t, None
                continue
            if failed is None:
                failed = bytearray(n // 8 + 1)
            failed[at >> 3] |= 1 << (at & 7)  # the last unit is tried again and can't end here now
            t = taken.pop()
            at -= size[t] if t >= 0 else 1
            before = taken[-1] if taken else None
        return taken

    def packed(self, text: str) -> bytes:
        """Packed ids of a text after normalisation."""
        out = self.units(text)
        if min(out, default=0) < 0:
            of = lambda c: [self.bytes[b] for b in chr(-1 - c).encode()] if self.byte_fallback else [self.unknown]
            out = array("i", [i for u in out for i in ([u] if u >= 0 else of(u))])
        return out.tobytes()

    def encode_normal(self, text: str) -> bytes:
        """Packed ids of a text that is normalised already."""
        if self.cut is None:
            return self.packed(text)
        return b"".join(map(self.segments.__getitem__, self.cut.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as the library's encode gives them."""
        return np.frombuffer(self.encode_normal(self.library.normalize(text)), np.int32) if text else np.zeros(0, np.int32)


@functools.lru_cache(maxsize=2)
def model(path: str) -> MergeModel:
    return MergeModel(path)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", to: str = "piece_ids") -> DataFrame:
    """Add ``to``: array<int>, the ids of the whole text, without begin and end ids."""

    def run(batches):
        one = model(model_path)
        for batch in pieces(batches):
            rows = [one.encode(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text_col))]
            ends = np.cumsum([0, *map(len, rows)])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield _with(batch, to, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))

    return docs.mapInArrow(trimmed(run), _schema(docs, to, T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, model_path: str, ids_col: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """Add ``to``: string, the library's text of the ids; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        sp = model(model_path).library
        for batch in pieces(batches):
            rows = batch.column(batch.schema.get_field_index(ids_col))
            yield _with(batch, to, pa.array([sp.decode(r.values.to_pylist()) if r.is_valid and len(r.values) else "" for r in rows], pa.string()))

    return tokens.mapInArrow(trimmed(run), _schema(tokens, to, T.StringType()))
