"""Byte-pair tokens as strings with one code point for each token.

Token ``i`` is the code point ``i``, the surrogate range left out; bytes are Latin-1.  Then a
merge is a plain string replacement, which has the same left-to-right, non-overlapping
meaning, and stays in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP, _GAP_SIZE = 0xD800, 0x800


def symbol(token: int) -> str:
    return chr(token if token < _GAP else token + _GAP_SIZE)


def token(char: str) -> int:
    return ord(char) if ord(char) < _GAP else ord(char) - _GAP_SIZE


def byte_word(text: Column) -> Column:
    """The UTF-8 bytes of a string, a code point each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def tokens_of(word: Column) -> Column:
    """array<int>: token ids of a word; none for the empty word."""
    ids = F.transform(F.split(word, ""), lambda c: F.ascii(c) - F.when(F.ascii(c) >= _GAP, _GAP_SIZE).otherwise(0))
    return F.when(word == "", F.array().cast("array<int>")).otherwise(ids)


def adjacent_pairs(word: Column) -> Column:
    """array<string>: overlapping pairs of neighbours."""
    chars, n = F.split(word, ""), F.char_length(word)
    pairs = F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, 2, n - 1), lambda a, b: F.concat(a, b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def pair_counts(words: DataFrame) -> DataFrame:
    """words(word, n) -> pair, n: each pair weighted by its word's count."""
    return words.select(F.explode(adjacent_pairs(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equals that with the smallest tokens."""
    return pairs.orderBy(F.col("n").desc(), F.ascii("pair"), F.ascii(F.substring("pair", 2, 1))).limit(1)


def merged(word: Column, left: int, right: int, new: int) -> Column:
    return F.replace(word, F.lit(symbol(left) + symbol(right)), F.lit(symbol(new)))


def fragment_counts(fragments: DataFrame, fragment: str = "fragment") -> DataFrame:
    """fragment, n: how often each fragment occurs."""
    return fragments.groupBy(fragment).agg(F.count("*").alias("n"))


def wrapped(ids: Column, begin: int, end: int) -> Column:
    return F.concat(F.array(F.lit(begin)), ids, F.array(F.lit(end)))


def truncated(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, max(length, 0))


def padded(ids: Column, length: Column | int, pad: int) -> Column:
    """Exactly ``length`` tokens: cut or filled up."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(n, F.lit(0)))), F.lit(1), F.greatest(n, F.lit(0)))
