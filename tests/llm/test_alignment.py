"""Cross-tokenizer alignment against comparing all byte offsets, and counts against counting in Python."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fragmill.llm import token_align
from fragmill.llm.queries import QUERIES
from fragmill.llm.token_orc import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "▁", "a ▁ b", "a\x00b", "\t\n a", "ﬁ é", "é", "<|endoftext|> x", "<s> </s> <0x41>", "日本語テキスト 𝔘𝔫𝔦", "😀👩‍👩‍👧 x", "�", "12 345,678", "a" * 500, " " * 90, "x y　z", "word. " * 40, "\r\n\r\nline end"]


def byte_texts():
    rng = random.Random(4)
    out = ["".join(rng.choice(["the ", "ing", " ", "  ", "\n", "é", "日", ".", "Token", "izer", "▁", "ﬁ", "<s>", "\t", "7"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    return out + ["".join(chr(rng.choice([32, rng.randrange(32, 127), rng.randrange(0x2FFF)])) for _ in range(rng.randint(1, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def brute():
    a, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = {c: b for b, c in byte_alphabet().items()}

    def one(text):
        """A ids, B ids and groups, as the contract says."""
        if not text:
            return [], [], []
        x, y = a.encode(f" {text}", add_special_tokens=False), sp.encode(text)
        raw_a = [bytes(of[c] for c in t) for t in x.tokens]
        raw_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, map(sp.id_to_piece, y))]
        if b"".join(raw_a) != f" {text}".encode() or b"".join(raw_b) != f" {text}".encode():
            return [], [], []
        ends_a, ends_b = [*accumulate(map(len, raw_a))], [*accumulate(map(len, raw_b))]
        at_a, at_b = ({end: k for k, end in enumerate(ends, 1)} for ends in (ends_a, ends_b))
        ids, groups, i, j = x.ids, [], 0, 0
        for end in sorted(at_a.keys() & at_b.keys()):
            p, q = at_a[end], at_b[end]
            groups.append((ids[i:p], y[j:q]))
            i, j = p, q
        return ids, y, groups

    return one


def test_documents(brute):
    one = token_align.aligner(A, B)
    kinds = Counter()
    for text in ODD + byte_texts():
        a, b, groups = brute(text)
        n_a, n_b, joined, links = one.document(text)
        want = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert (n_a, n_b, joined.decode(), len(links) // 8) == (len(a), len(b), want, len(groups)), text
        kinds[bool(groups)] += 1
    assert min(kinds.values()) > 20


def test_words_are_stretches_of_their_own(brute):
    """A word is remembered once, whatever stands behind it; cuts change nothing."""
    one = token_align.Aligner(A, B)
    one.document("alpha. alpha, alpha; alpha's alpha-7 (alpha) alpha")
    assert {" alpha", ".", ",", "'s", "-7"} <= one.known.keys() and not any(f" alpha{c}" in one.known for c in ".,;'-")
    rng = random.Random(11)
    for _ in range(4000):
        text = "".join(rng.choice(["don't", "'s", "'ll", "'", "we", "é", "e\u0301", "\u0338", "=", "<", ">", "(", ")", ".", "...", "1", "²", "ﬁ", "ĳ", "ŉ", "ſ", "ñ", "ǆ", "ß", " ", "  ", "\n", "\t", "▁", "日", "я", "_", "-", "~", "<s>", "<0x41>"]) for _ in range(rng.randint(1, 14)))
        a, b, groups = brute(text)
        want = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_a, n_b, joined, links = one.document(text)
        assert (n_a, n_b, joined.decode(), len(links) // 8) == (len(a), len(b), want, len(groups)), text


def test_long_texts(brute):
    one = token_align.aligner(A, B)
    text = " ".join(random.Random(3).choices(["alpha", "beta.", "Gamma,", "日本", "12", "\n"], k=30_000)) + "x" * 2000
    a, b, groups = brute(text)
    assert one.document(text)[:2] == (len(a), len(b)) and len(one.document(text)[3]) // 8 == len(groups)


def test_stabbing_queries():
    index = token_align.Intervals([2, 5, 6, 9])
    for start in range(9):
        for end in range(start + 1, 10):
            assert list(index.stab(start, end)) == [k for k, (s, e) in enumerate([(0, 2), (2, 5), (5, 6), (6, 9)]) if s < end and e > start]


def check(rows, got, brute):
    found = [brute(t) for _, t in rows]
    counts = Counter((x[-1], y[-1]) for _, _, gs in found for x, y in gs)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    want = []
    for (i, _), (a, b, gs) in zip(rows, found):
        links = [(x[-1], y[-1]) for x, y in gs]
        joined = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
        digest = hashlib.sha256(joined.encode()).hexdigest() if joined else ""
        want.append((i, len(a), len(b), len(gs), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query(spark, tmp_path, brute):
    rows = [*enumerate(ODD + byte_texts()[:120])] + [(3, "again the same"), (3, "again the same"), (None, "null id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, map(tuple, QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()), brute)


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_scores(spark, brute, broadcast_rows):
    """Broadcast or shuffled, with columns whose names clash."""
    rows = [*enumerate(["same words " * 50, "same words", None, "other text"])]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, pairs string, n long")
    out = token_align.scores(token_align.align(docs, A, B), broadcast_rows)
    assert [c for c in out.columns if c in ("pairs", "times", "_row")] == []
    got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in out.collect()]
    check(rows, got, brute)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.scores(token_align.align(none, A, B), broadcast_rows).count() == 0
