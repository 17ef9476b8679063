"""Training, encoding, decoding, batches, files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmill.api import SafeTokenizer, safe_encode
from fragmill.operators import tokens as tk
from fragmill.plans import evaluate
from fragmill.plans.model import FragmentTokenizer, _fold
from fragmill.plans.trainer import BpeTrainer, learn, learn_distributed, merges_wanted
from fragmill.sources import tables

CORPUS = ["CCCOCC", "CC(=O)Oc1ccccc1C(=O)O", "CC(C)Cc1ccc(C(C)C(=O)O)cc1", "O=C(CN1CC[NH2+]CC1)N1CCCCC1", "not_valid"] * 20
CELECOXIB = "Cc1ccc(-c2cc(C(F)(F)F)nn2-c2ccc(S(N)(=O)=O)cc2)cc1"


@pytest.fixture(scope="module")
def model(spark):
    found = SafeTokenizer()
    found.train_from_iterator(iter(CORPUS), 300, spark=spark)
    return found


def naive(texts, n):
    """Training by recounting everything each step."""
    words = [(list(t.encode()), c) for t, c in texts]
    out = []
    for step in range(n):
        counts = {}
        for w, c in words:
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + c
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        out.append(best)
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [256 + step]
                i += 1
    return out


def test_small_cases():
    assert learn([("ab", 10), ("cd", 5)], 1) == [(97, 98)]
    assert learn([("aaa", 10)], 2) == [(97, 97), (256, 97)]
    assert learn([("a", 3)], 5) == []
    assert merges_wanted(261) == 0
    with pytest.raises(ValueError):
        merges_wanted(260)


def test_learn_equals_recounting(spark):
    texts = [("abracadabra", 3), ("cadabra", 2), ("aaaaaa", 1), ("äöü äöü", 4), ("", 7)]
    expected = naive(texts, 25)
    assert learn(texts, 25) == expected
    df = spark.createDataFrame(texts, "fragment string, n long")
    assert learn_distributed(df, 6, every=2) == expected[:6]


def test_layout(model):
    assert model.vocab_size == 300 and len(model.get_vocab()) == 300
    assert [model.dot_token_id, model.pad_token_id, model.bos_token_id, model.eos_token_id, model.unk_token_id] == list(range(295, 300))
    assert FragmentTokenizer().vocab_size == 261


@pytest.mark.parametrize("smiles", ["CCCOCC", CELECOXIB, "CCO", "not_valid", "", "α.β"])
def test_scalar_round_trip(model, smiles):
    try:
        expected = safe_encode(smiles)
    except ValueError:
        expected = smiles
    ids = model.encode(smiles)
    assert model.decode(ids) == expected
    assert all(0 <= i < model.vocab_size for i in ids)
    assert model.encode(smiles, add_special_tokens=True) == [model.bos_token_id, *ids, model.eos_token_id]


def test_dots(model):
    assert model.encode(CELECOXIB).count(model.dot_token_id) == 3
    assert model.dot_token_id not in model.encode("CCO")
    assert model.dot_token_id not in model.encode("no.t valid")


def test_batches(model):
    batch = model.batch_encode(["CCCOCC", "CCO", CELECOXIB])
    rows = [model.encode(s) for s in ("CCCOCC", "CCO", CELECOXIB)]
    assert batch.dtype == np.uint32 and batch.shape == (3, max(map(len, rows)))
    for got, want in zip(batch, rows):
        assert got[: len(want)].tolist() == want and set(got[len(want) :].tolist()) <= {model.pad_token_id}
    assert model.batch_encode([CELECOXIB], max_length=5).shape == (1, 5)
    assert model.batch_encode([]).shape == (0, 0)
    assert model.batch_encode(["CCO"], max_length=1, add_special_tokens=True).tolist() == [[model.bos_token_id]]
    assert model.batch_decode([r for r in rows]) == [model.decode(r) for r in rows]


def test_shuffle(model):
    seen = {tuple(model.encode(CELECOXIB, shuffle=True)) for _ in range(30)}
    assert len(seen) > 1
    assert {tuple(sorted(model.decode(list(s)).split("."))) for s in seen} == {tuple(sorted(safe_encode(CELECOXIB).split(".")))}


def test_additional_tokens(spark):
    model = FragmentTokenizer([(67, 67)])
    model.add_tokens(["ENSG00000141510", "ENSG00000141510"])
    model.add_tokens(["ENSG00000141510"])
    assert model.num_additional_tokens == 1
    assert model.encode("ENSG00000141510") == [model.vocab_size - 1]
    df = spark.createDataFrame([("ENSG00000141510",), ("CC",), (None,)], "smiles string")
    got = {r["smiles"]: r["ids"] for r in model.encode_table(df).collect()}
    assert got["ENSG00000141510"] == [model.vocab_size - 1] and got["CC"] == [256]


def test_files(tmp_path, model):
    path = str(tmp_path / "model.json")
    model.save(path)
    again = FragmentTokenizer.load(path)
    assert again.merges == model.merges and again.encode(CELECOXIB) == model.encode(CELECOXIB)
    (tmp_path / "old.json").write_text(json.dumps({"version": 1, "merges": [[[67, 67], 256]], "num_merges": 1}))
    assert FragmentTokenizer.load(str(tmp_path / "old.json")).encode("CCC") == [256, 67]
    (tmp_path / "bad.json").write_text(json.dumps({"version": 1, "merges": [[[67, 999], 256]]}))
    for bad in ("bad.json", "none.json"):
        with pytest.raises(OSError):
            FragmentTokenizer.load(str(tmp_path / bad))


@pytest.mark.parametrize("merges", [0, 30, 250])
def test_columns_equal_scalars(spark, merges):
    corpus = [(s, 1) for s in (" ".join(CORPUS[:5]), "äöü 😀 tokens and more tokens " * 3, *[f"word{i} wording{i * 7}" for i in range(60)])]
    model = FragmentTokenizer(learn(corpus, merges))
    texts = ["CCCOCC", CELECOXIB, "not_valid", "", "äöü 😀 tokens", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "mol_id long, smiles string")
    out = model.encode_table(df).withColumn("text", model.decoded(F.col("ids")))
    for r in out.collect():
        if r["smiles"] is not None:
            assert r["ids"] == model.encode(r["smiles"])
            assert r["text"] == model.decode(r["ids"])
    wrapped = model.encode_table(df.where("smiles IS NOT NULL"), add_special_tokens=True, max_length=6, pad=True)
    expected = model.batch_encode([t for t in texts if t is not None], max_length=6, add_special_tokens=True)
    assert np.array_equal(tables.to_numpy(wrapped), expected)
    longest = model.encode_table(df.where("smiles IS NOT NULL"), pad=True)
    assert np.array_equal(tables.to_numpy(longest), model.batch_encode([t for t in texts if t is not None]))


def test_lossy_decoding(spark):
    model = FragmentTokenizer()
    for ids in ([0xF0, 0x9F, 0x98], [0x41, 0xFF, 0x42], [999, 0x41, -1]):
        got = spark.range(1).select(model.decoded(F.array(*map(F.lit, ids))).alias("t")).first()["t"]
        assert got == model.decode(ids)


def test_byte_pairs_overlap(spark):
    row = spark.range(1).select(tk.adjacent_pairs(F.lit("aaa")).alias("p"), tk.adjacent_pairs(F.lit("a")).alias("one"), tk.tokens_of(F.lit("")).alias("none")).first()
    assert row["p"] == ["aa", "aa"] and row["one"] == [] and row["none"] == []


def test_symbols_skip_surrogates():
    for i in (0, 255, 256, 0xD7FF, 0xD800, 70_000):
        assert tk.token(tk.symbol(i)) == i
        tk.symbol(i).encode()


def test_fold_is_lowest_id_first():
    assert _fold(((67, 67, 256),))("CCC") == (256, 67)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("smiles,x\nCCO,1\n,2\nCCN,3\n")
    assert sorted(r["smiles"] for r in tables.from_csv(spark, str(tmp_path)).collect()) == ["CCN", "CCO"]
    with pytest.raises(TypeError):
        tables.from_iterator(spark, ["C", 1])
    with pytest.raises(ValueError):
        tables.from_iterator(spark, ["C"], buffer_size=0)
    rows = tables.from_list(spark, ["a", "b", "c"])
    assert [r["smiles"] for r in tables.first_rows(rows, 2).collect()] == ["a", "b"]


def test_evaluation(spark, tmp_path, model):
    df = tables.from_list(spark, [CELECOXIB, "junk text", "CCO"])
    for shuffle in (False, True):
        tested = evaluate.round_trips(df, model, shuffle=shuffle)
        assert evaluate.accuracy(tested).first().asDict() == {"n": 3, "n_ok": 3, "accuracy": 1.0}
    out = evaluate.run(df, df, 280, failures_path=str(tmp_path / "failures"))
    assert out.first()["n_ok"] == 3
    assert spark.read.csv(str(tmp_path / "failures"), header=True).count() == 0


def test_trainer_uses_distributed_steps_beyond_the_limit(spark):
    df = tables.from_list(spark, ["CCCC", "CCO", "CCN", "junk junk"])
    assert BpeTrainer(265, local_limit=1).fit(df).merges == BpeTrainer(265).fit(df).merges


def test_command_line(spark, tmp_path, capsys):
    from fragmill.__main__ import main

    (tmp_path / "a.csv").write_text("smiles\nCCO\nCCCOCC\nnot_valid\n")
    assert main([str(tmp_path / "a.csv"), "--train-n", "2", "--vocab-size", "265", "--shuffle"]) == 1.0
    assert "3 of 3" in capsys.readouterr().out


def test_sql_functions(spark):
    from fragmill.functions.sql import register

    register(spark)
    assert spark.sql("SELECT safe_encode('CCCOCC') AS s").first()["s"] == "CCC1.O12.C2C"
    assert spark.sql("SELECT is_valid_smiles('C(C') AS s").first()["s"] is False
    rows = spark.sql("SELECT pos, fragment FROM explode_fragments('CCCOCC') ORDER BY pos").collect()
    assert [(r["pos"], r["fragment"]) for r in rows] == [(0, "CCC1"), (1, "O12"), (2, "C2C")]
