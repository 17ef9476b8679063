"""SentencePiece encoding by backtracking: against the library, and against merging character by character."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from fragmill.llm import piece_codec
from fragmill.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "a", " a", "a ", "▁", "a▁b", "\x00", "a\x00b", "\t\n a", "ﬁ é", "<s> </s> <unk> <0x41>", "日本語テキスト 𝔘𝔫𝔦", "😀👩‍👩‍👧 x", "�", "12 345,678", "a" * 500, " " * 500, "=-" * 400, "x" * 150 + " " * 70 + "y", "İstanbul ẞ ſ"]


@pytest.fixture(scope="module")
def one():
    return piece_codec.model(MODEL)


def test_against_the_library(one):
    rng = random.Random(5)
    pool = list(one.ids)
    texts = [t for t in ODD if t is not None]
    for i in range(4000):
        kind = i % 4
        if kind == 0:
            texts.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 12))))
        elif kind == 1:
            texts.append("".join(rng.choice("aetion sr  ▁lh") for _ in range(rng.randint(1, 60))))
        elif kind == 2:
            texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), 0x1F600 + rng.randrange(50), 32])) for _ in range(rng.randint(0, 80))))
        else:
            texts.append(" ".join(rng.choice(pool).strip("▁") + rng.choice(["", ".", "\n", "s", "ing,", "1"]) for _ in range(rng.randint(1, 30))))
    for text, want in zip(texts, one.library.encode(texts, num_threads=1)):
        assert one.encode(text).tolist() == want, text


def test_backtracking_is_merging(one):
    """Units of whole texts, spaces included, are those of merging from single characters."""
    rng = random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choice(["the", "er", "in", "▁", "▁▁", "a", "t", "h", "ing", "ab", "é", "日", "€x"]) for _ in range(rng.randint(1, 14)))
        assert [one.unit(u) for u in one.units(text)] == one.merged(text)


def test_texts_that_need_going_back(one):
    """Among them are texts whose longest first piece is wrong, and the bitfield stops repeated failures."""
    wrong = [p for p in list(one.ids)[:6000] for q in ("able", "ing", "ation") if (u := one.units(p + q)) and one.size[u[0]] < one.size.get(one.longest(p + q)[0], 0)]
    assert len(wrong) > 20
    assert one.encode("ation" * 4000).tolist() == one.library.encode("ation" * 4000)


def test_runs_of_letters_are_segments(one):
    """A word is remembered once, whatever stands behind it; long segments are not remembered."""
    assert one.apart() and one.cut.findall("▁Weilo.▁(Weilo)▁▁x=1,²é!") == ["▁Weilo", ".", "▁(", "Weilo", ")", "▁▁x", "=", "1", ",²", "é", "!"]
    long = "weilo" * 30
    one.encode(f"Weilo, Weilo. {long}")
    assert "▁Weilo" in one.segments and not any(f"▁Weilo{c}" in one.segments for c in ",.") and f"▁{long}" not in one.segments
    rng = random.Random(12)
    texts = ["".join(rng.choice(["Weilo", "thsherst", "é", "e\u0301", "ñí", "'", ".", ",", "...", "***", "7", "²", " ", "  ", "▁", "日本", "я", "ß", "🙂", "\n", "\u200b"]) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for text, want in zip(texts, one.library.encode(texts, num_threads=1)):
        assert one.encode(text).tolist() == want, text


def test_a_model_without_cuts_gives_the_same(one):
    cut, one.cut = one.cut, None
    try:
        for text in ["two words\n and 3 more", " lead", "trail "]:
            assert one.encode(text).tolist() == one.library.encode(text)
    finally:
        one.cut = cut


def test_tables(spark):
    schema = "doc_id long, text string, piece_ids string, decoded long"
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(0, "again", "x", 2), (0, "again", "x", 2), (None, "null id", None, None)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    out = piece_codec.decode(piece_codec.encode(df, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "piece_ids", "decoded"]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = sp.encode(r["text"] or "")
        assert r["piece_ids"] == want and r["decoded"] == sp.decode(want)
    none = spark.createDataFrame([], schema)
    assert piece_codec.decode(piece_codec.encode(none, MODEL), MODEL).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op13_sentencepiece"](spark, str(tmp_path)).collect():
        ids = sp.encode(ODD[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
