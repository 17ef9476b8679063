"""Queries over the driver's tables, and the same in SQL.  Molecule strings come from fixtures, joined by modulo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions import cleavage, graph
from fragmill.functions.columns import is_valid_smiles, safe_encode, safe_fragments, write_smiles
from fragmill.operators import assembly, isomorphism, molecules
from fragmill.operators import tokens as tk
from fragmill.plans import evaluate
from fragmill.plans.fixtures import ACCEPTED, CHANGED, MARKED, MOLECULES, REJECTED, RULES, SAME, SCAFFOLDS, WRITTEN, values
from fragmill.plans.fixtures import molecules as fixture
from fragmill.plans.model import FragmentTokenizer
from fragmill.plans.trainer import BpeTrainer, train_from_iterator, weighted_fragments
from fragmill.sources import tables as sources
from fragmill.sources.shared import shared_file
from fragmill.streaming.encode import encoded

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str, rows: list[tuple], schema: str) -> DataFrame:
    """key of every row of a table with the fixture row that its key selects."""
    fix = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"fix_id long, {schema}")
    keys = table(spark, sf_dir, name).select(F.col(key), F.pmod(key, F.lit(len(rows))).alias("fix_id"))
    return keys.join(F.broadcast(fix), "fix_id").drop("fix_id")  # a literal fixture


def _sql(name: str, key: str, rows: list[tuple], columns: str, select: str, tail: str = "") -> str:
    numbered = [(i, *r) for i, r in enumerate(rows)]
    return f"SELECT {select} FROM {name} t JOIN {values(numbered, f'f(fix_id, {columns})')} ON t.{key} % {len(rows)} = f.fix_id {tail}"


_STRINGS = [(m[0],) for m in MOLECULES]
_GOLD = [(m[0], m[1]) for m in MOLECULES]
_FRAGMENTS = "CASE WHEN f.safe IS NULL THEN [f.smiles] ELSE string_split(f.safe, '.') END"
#: A small model for token queries: merges of common English byte pairs.
MODEL = FragmentTokenizer([(ord("e"), ord(" ")), (ord("t"), ord("h")), (257, ord("e")), (ord("i"), ord("n")), (259, ord("g"))], ["click", "view", "purchase"])
_BYTES = "array_to_string(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: chr(('0x' || x)::INT)), '')"


def _sql_word(text: str, merges=MODEL.triples()) -> str:
    word = _BYTES.format(text)
    for a, b, z in merges:
        word = f"replace({word}, chr({a}) || chr({b}), chr({z}))"
    return word


def _sql_ids(text: str) -> str:
    return f"list_transform(regexp_extract_all({_sql_word(text)}, '(?s).'), lambda c: unicode(c))"


@query("SELECT regexp_full_match(w, '(Br|Cl|Si|Se|[BCNOPSFIcnosp])+') AS valid, count(*) AS n_words, count(DISTINCT w) AS n_distinct FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY 1")
def lex_valid_words(spark, sf_dir):
    """Which letter-only words of all documents are molecules?"""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.withColumn("valid", is_valid_smiles("w")).groupBy("valid").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


@query(_sql("part", "p_partkey", [(s, True) for s in ACCEPTED] + [(s, False) for s in REJECTED], "smiles, ok", "p_partkey, smiles, ok AS accepted"))
def accepted_strings(spark, sf_dir):
    rows = keyed(spark, sf_dir, "part", "p_partkey", [(s,) for s in ACCEPTED + REJECTED], "smiles string")
    return molecules.per_string(rows, lambda d: d.withColumn("accepted", is_valid_smiles("smiles"))).select("p_partkey", "smiles", "accepted")


@query(_sql("part", "p_partkey", _STRINGS, "smiles", "p_partkey, array_to_string(list_transform(regexp_extract_all(regexp_replace(smiles, '\\[.*?\\]', '', 'g'), '%[0-9][0-9]|[0-9]'), lambda x: CAST(CAST(replace(x, '%', '') AS INT) AS VARCHAR)), ' ') AS numbers"))
def ring_numbers(spark, sf_dir):
    rows = keyed(spark, sf_dir, "part", "p_partkey", _STRINGS, "smiles string")
    return rows.select("p_partkey", F.array_join(assembly.ring_numbers(F.col("smiles")).cast("array<string>"), " ").alias("numbers"))


@query(_sql("supplier", "s_suppkey", [s[:2] for s in SCAFFOLDS], "smiles, scaffold", "s_suppkey, array_to_string(list_sort(list_distinct(regexp_extract_all(scaffold, '\\[[0-9]+\\*\\]'))), ' ') AS labels"))
def attachment_labels(spark, sf_dir):
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", [s[:2] for s in SCAFFOLDS], "smiles string, scaffold string")
    return rows.select("s_suppkey", F.array_join(assembly.attachment_labels(F.col("scaffold")), " ").alias("labels"))


@query(_sql("supplier", "s_suppkey", SCAFFOLDS, "smiles, scaffold, safe", "s_suppkey, safe"))
def assembled_scaffolds(spark, sf_dir):
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", [s[:2] for s in SCAFFOLDS], "smiles string, scaffold string")
    return rows.select("s_suppkey", assembly.assemble(F.col("scaffold"), F.col("smiles")).alias("safe"))


@query(_sql("lineitem", "l_partkey", _GOLD, "smiles, safe", "l_orderkey, l_linenumber, safe"))
def safe_encode_batch(spark, sf_dir):
    """Each distinct string is encoded once, then joined to all rows."""
    fix = fixture(spark).withColumn("safe", safe_encode("smiles"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(len(MOLECULES))).alias("mol_id"))
    return rows.join(F.broadcast(fix), "mol_id").select("l_orderkey", "l_linenumber", "safe")


@query(_sql("orders", "o_orderkey", _GOLD, "smiles, safe", "fragment, count(*) AS n", f", unnest({_FRAGMENTS}) u(fragment) GROUP BY 1"))
def fragment_counts(spark, sf_dir):
    rows = keyed(spark, sf_dir, "orders", "o_orderkey", _STRINGS, "smiles string")
    return weighted_fragments(rows)


@query(_sql("customer", "c_custkey", [(m[0], m[2]) for m in MOLECULES if m[1] is not None], "smiles, cuts", "c_custkey, CAST(cuts AS INT) AS n_cuts"))
def cut_bond_counts(spark, sf_dir):
    """Cuts found with built-in expressions over the parsed struct."""
    rows = keyed(spark, sf_dir, "customer", "c_custkey", [(m[0],) for m in MOLECULES if m[1] is not None], "smiles string")
    cut = molecules.per_string(rows, lambda d: molecules.parsed(d).select("smiles", F.size(molecules.cut_bonds(F.col("molecule"))).alias("n_cuts")))
    return cut.select("c_custkey", "n_cuts")


@query(_sql("customer", "c_custkey", [(m[0], m[1]) for m in MOLECULES if m[1] is not None and not m[2] and "*" not in m[0]], "smiles, safe", "c_custkey, safe AS written"))
def written_uncut(spark, sf_dir):
    rows = keyed(spark, sf_dir, "customer", "c_custkey", [(m[0],) for m in MOLECULES if m[1] is not None and not m[2] and "*" not in m[0]], "smiles string")
    return molecules.per_string(rows, lambda d: d.withColumn("written", write_smiles("smiles"))).select("c_custkey", "written")


def _graphs(strings: list[str]) -> str:
    """SQL: atoms and bonds of the strings, as literals; everything else is worked out in SQL."""
    atoms, bonds = [], []
    for i, text in enumerate(strings):
        m = graph.parse(text)
        if m is not None:
            atoms += [(i, a, m.element[a], m.charge[a], m.aromatic[a], m.written_h[a], m.implied_h[a], m.bracket[a]) for a in range(len(m))]
            bonds += [(i, k, a, b, m.order[k]) for k, (a, b) in enumerate(m.ends)]
    return f"""
atoms AS (SELECT * FROM {values(atoms, "t(mol, i, z, q, ar, wh, ih, br)")}), bonds AS (SELECT * FROM {values(bonds, "t(mol, k, a, b, o)")}),
ends AS (SELECT mol, k, a, b, o FROM bonds UNION ALL SELECT mol, k, b, a, o FROM bonds),
reach(mol, k, node) AS (SELECT mol, k, a FROM bonds UNION SELECT r.mol, r.k, e.b FROM reach r JOIN ends e ON e.mol = r.mol AND e.a = r.node AND e.k <> r.k),
rings AS (SELECT b.*, EXISTS (SELECT 1 FROM reach r WHERE r.mol = b.mol AND r.k = b.k AND r.node = b.b) AS ring FROM bonds b),
near AS (SELECT e.mol, e.k, e.a AS i, e.b AS j, e.o, r.ring, n.z, n.ar FROM ends e JOIN rings r USING (mol, k) JOIN atoms n ON n.mol = e.mol AND n.i = e.b),
sums AS (SELECT a.*, count(n.k) AS degree, coalesce(bool_or(n.ring), false) AS in_ring, coalesce(sum(CASE n.o WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 1 THEN 1 WHEN 4 THEN 1 END), 0) AS order_sum,
  coalesce(bool_or(n.o = 2 AND n.z = 8), false) AS keto, coalesce(bool_or(n.o = 2), false) AS dbl FROM atoms a LEFT JOIN near n ON n.mol = a.mol AND n.i = a.i GROUP BY ALL),
f AS (SELECT s.*, n.*, x.keto AS near_keto FROM sums s LEFT JOIN (SELECT mol AS m2, i AS i2, j, o, ring, z AS nz, ar AS nar FROM near) n ON n.m2 = s.mol AND n.i2 = s.i LEFT JOIN (SELECT mol AS m3, i AS i3, keto FROM sums) x ON x.m3 = n.m2 AND x.i3 = n.j),
env AS (SELECT mol, i, z, ar, in_ring, degree, order_sum, wh, ih, br,
  z = 6 AND NOT ar AND degree = 3 AND keto AND bool_or(nz IN (0, 6, 7, 8)) AS acyl,
  z = 8 AND NOT ar AND degree = 2 AND bool_or(o = 1 AND NOT ring AND nz IN (0, 1, 6)) AS ether_o,
  z = 7 AND NOT ar AND degree > 1 AND NOT dbl AND bool_and(o <> 1 OR nz IN (0, 1, 6, 16)) AND NOT bool_or(ring AND nz = 6 AND near_keto) AS amine_n,
  z = 7 AND bool_or(ring AND nz = 6 AND near_keto) AND bool_or(ring AND nz IN (6, 7, 8, 16)) AS ring_amide_n,
  z = 6 AND NOT ar AND degree > 1 AND NOT dbl AND bool_or(o = 1 AND NOT ring AND nz = 6) AS sp3_c,
  z = 6 AND NOT ar AND bool_or(ring AND nz IN (7, 8, 16)) AS hetero_ring_c,
  z = 6 AND ar AND bool_or(o = 4 AND nar AND nz IN (7, 8, 16)) AS arom_c_hetero,
  z = 6 AND NOT ar AND count(*) FILTER (WHERE ring AND nz = 6) >= 2 AS carbo_ring_c,
  z = 6 AND ar AND count(*) FILTER (WHERE o = 4 AND nar AND nz = 6) >= 2 AS arom_c_ring,
  z = 16 AND NOT ar AND degree = 2 AND bool_or(o = 1 AND NOT ring AND nz IN (0, 6)) AS thioether_s,
  z = 16 AND NOT ar AND degree = 4 AND bool_or(nz IN (0, 6)) AND count(*) FILTER (WHERE o = 2 AND nz = 8) >= 2 AS sulfonyl,
  z = 6 AND NOT ar AND degree = 3 AND NOT in_ring AND keto AND bool_or(o = 1 AND NOT ring AND nz IN (0, 6, 7, 8)) AS open_acyl,
  z = 6 AND NOT ar AND degree IN (2, 3) AND bool_or(nz = 6 AND NOT nar) AS alkene_c,
  z = 6 AND NOT ar AND NOT in_ring AND degree > 1 AND bool_and(o = 1) AS open_sp3_c,
  z = 7 AND ar AND q = 0 AND count(*) FILTER (WHERE o = 4 AND nar AND nz IN (6, 7, 8, 16)) >= 2 AS arom_n
  FROM f GROUP BY mol, i, z, q, ar, in_ring, degree, order_sum, wh, ih, br, keto, dbl)"""


_ENVS = cleavage.ENVIRONMENTS
_RULE_STRINGS = [r[2] for r in RULES]
_ALL_STRINGS = [m[0] for m in MOLECULES] + [m[0] for m in MARKED] + _RULE_STRINGS
_NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{e}' END" for e in _ENVS) + "], lambda x: x IS NOT NULL), ' ')"
_NO = len(_ALL_STRINGS)


@query(f"WITH RECURSIVE {_graphs(_ALL_STRINGS)} SELECT z AS element, ar AS aromatic, in_ring, count(*) AS n, sum(ih) AS n_implied_h FROM part t JOIN env ON env.mol = t.p_partkey % {_NO} GROUP BY 1, 2, 3")
def atom_environments(spark, sf_dir):
    """Atoms by element and ring over all parts' molecules."""
    rows = keyed(spark, sf_dir, "part", "p_partkey", [(s,) for s in _ALL_STRINGS], "smiles string").groupBy("smiles").agg(F.count("*").alias("times"))
    atoms = molecules.atoms(molecules.parsed(rows), "times")
    return atoms.groupBy("element", "aromatic", "in_ring").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("implied_h")).alias("n_implied_h"))


@query(f"WITH RECURSIVE {_graphs(_ALL_STRINGS)} SELECT t.p_partkey, i AS atom, degree, CAST(order_sum AS INT) AS order_sum, in_ring, wh + greatest(ih, 0) AS total_h, {_NAMES} AS environments FROM part t JOIN env ON env.mol = t.p_partkey % {_NO}")
def atom_facts(spark, sf_dir):
    """Degree, bond orders, ring and environments of every atom, worked out again in SQL from bare atoms and bonds."""
    rows = keyed(spark, sf_dir, "part", "p_partkey", [(s,) for s in _ALL_STRINGS], "smiles string")
    told = molecules.per_string(rows, lambda d: molecules.parsed(d))
    atoms = molecules.atoms(told, "p_partkey")
    names = F.array_join(F.filter(F.array(*[F.when(molecules.in_environment(F.col("environments"), e), F.lit(e)) for e in _ENVS]), lambda x: x.isNotNull()), " ")
    return atoms.select("p_partkey", "atom", F.col("degree").cast("long").alias("degree"), "order_sum", "in_ring", (F.col("written_h") + F.greatest("implied_h", F.lit(0))).alias("total_h"), names.alias("environments"))


def _rules_sql() -> str:
    table = values([(a, b, d) for a, b, d in cleavage.rules()], "r(left_env, right_env, d)")
    long = "SELECT mol, i, unnest(string_split(names, ' ')) AS e FROM (SELECT mol, i, " + _NAMES + " AS names FROM env)"
    either = "((x.e = r.left_env AND y.e = r.right_env) OR (x.e = r.right_env AND y.e = r.left_env))"
    hits = f"SELECT DISTINCT b.mol, b.k, r.left_env, r.right_env FROM rings b JOIN held x ON x.mol = b.mol AND x.i = b.a JOIN held y ON y.mol = b.mol AND y.i = b.b JOIN {table} ON {either} WHERE NOT b.ring AND CASE WHEN r.d THEN b.o = 2 ELSE b.o IN (1, 4) END"
    return f"WITH RECURSIVE {_graphs(_RULE_STRINGS)}, held AS ({long}), hits AS ({hits}) SELECT left_env, right_env, count(*) AS n FROM part t JOIN hits h ON h.mol = t.p_partkey % {len(RULES)} GROUP BY 1, 2"


@query(_rules_sql())
def rule_hits(spark, sf_dir):
    """How often each of the 46 rules names a bond: a molecule for every rule."""
    rows = keyed(spark, sf_dir, "part", "p_partkey", [(s,) for s in _RULE_STRINGS], "smiles string").groupBy("smiles").agg(F.count("*").alias("times"))
    hits = molecules.parsed(rows).select("times", F.explode(molecules.rule_hits(F.col("molecule"))).alias("r"))
    return hits.groupBy("r.left_env", "r.right_env").agg(F.sum("times").alias("n"))


@query(_sql("customer", "c_custkey", MARKED, "smiles, safe", "c_custkey, safe"))
def marked_encode(spark, sf_dir):
    """Chirality, directions, isotopes, maps, charges, written hydrogens, ring numbers from 10 on."""
    rows = keyed(spark, sf_dir, "customer", "c_custkey", [(m[0],) for m in MARKED], "smiles string")
    return molecules.per_string(rows, lambda d: d.withColumn("safe", safe_encode("smiles"))).select("c_custkey", "safe")


@query(_sql("supplier", "s_suppkey", WRITTEN, "smiles, written", "s_suppkey, written"))
def marked_written(spark, sf_dir):
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", [(m[0],) for m in WRITTEN], "smiles string")
    return molecules.per_string(rows, lambda d: d.withColumn("written", write_smiles("smiles"))).select("s_suppkey", "written")


_BRACKETS = [("[13CH3]C", 13, 0, 0, 0, 3), ("CC[CH2:1][OH:2]", 0, 0, 3, 0, 3), ("[NH4+]", 0, 1, 0, 0, 4), ("[O-]C", 0, -1, 0, 0, 0), ("[Fe++]", 0, 2, 0, 0, 0), ("[Fe+3]", 0, 3, 0, 0, 0), ("C[C@H](N)O", 0, 0, 0, 2, 1), ("C[C@@H](N)O", 0, 0, 0, 1, 1), ("[238U]", 238, 0, 0, 0, 0)]


@query(_sql("nation", "n_nationkey", _BRACKETS, "smiles, isotope, charge, maps, chiral, written_h", "n_nationkey, smiles, isotope, charge, maps, chiral, written_h"))
def bracket_fields(spark, sf_dir):
    """Sums of the fields that bracket atoms bring; marks of chirality as seen from the order of bonds, hydrogen first."""
    rows = keyed(spark, sf_dir, "nation", "n_nationkey", [(b[0],) for b in _BRACKETS], "smiles string")
    atoms = molecules.atoms(molecules.parsed(rows), "n_nationkey", "smiles")
    total = lambda c, to: F.sum(c).cast("int").alias(to)
    return atoms.groupBy("n_nationkey", "smiles").agg(total("isotope", "isotope"), total("charge", "charge"), total("atom_map", "maps"), total("chiral", "chiral"), total("written_h", "written_h"))


@query("SELECT n_nationkey AS mol_id, n_name AS smiles FROM nation")
def iterator_source(spark, sf_dir):
    """Names by a Python iterator, four at a time."""
    names = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name")
    return sources.from_iterator(spark, (r["n_name"] for r in names.toLocalIterator()), buffer_size=4)


@query("SELECT (SELECT count(*) FROM nation n2 WHERE n2.n_name < n.n_name) AS mol_id, n_name AS smiles FROM nation n")
def list_source(spark, sf_dir):
    return sources.from_list(spark, sorted(r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect()))  # 25 rows


@query("SELECT p_name AS smiles FROM part WHERE p_name IS NOT NULL AND p_name <> '' AND p_partkey % 3 > 0")
def csv_source(spark, sf_dir):
    """First column of CSV files, empty values left out."""
    path = shared_file(spark, "csv")
    names = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("name"), "p_type")
    names.write.csv(path, header=True)
    return sources.from_csv(spark, path)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10")
def first_ten(spark, sf_dir):
    return sources.first_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 10, "p_partkey")


@query(f"SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS at, array_to_string(list_concat(x, list_transform(range(0, n - len(x)), lambda i: {MODEL.pad_token_id})), ' ') AS ids FROM (SELECT n_nationkey, {_sql_ids('n_name')} AS x, max(len({_sql_ids('n_name')})) OVER () AS n FROM nation)")
def numpy_sink(spark, sf_dir):
    """Padded ids of the nations' names as an array on the driver."""
    padded = MODEL.encode_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", pad=True)
    array = sources.to_numpy(padded, order="n_nationkey")
    return spark.createDataFrame([(i, " ".join(map(str, r))) for i, r in enumerate(array.tolist())], "at long, ids string")


_FACTS = [("vocab_size", "269"), ("num_merges", "5"), ("dot", "261"), ("pad", "262"), ("bos", "263"), ("eos", "264"), ("unk", "265"), ("additional", "3"), ("empty_batch", "(0, 0) uint32"), ("default_vocab_size", "261"), ("default_merges", "0"), ("saved", "269"), ("readded", "3")]


@query(f"SELECT * FROM {values(_FACTS, 't(fact, value)')}")
def model_facts(spark, sf_dir):
    """Ids and counts of a model, the empty batch, the empty model, a model saved and read again."""
    import os
    import tempfile

    empty = MODEL.batch_encode([])
    with tempfile.TemporaryDirectory() as folder:  # model files are the driver's own
        MODEL.save(os.path.join(folder, "model.json"))
        again = FragmentTokenizer.load(os.path.join(folder, "model.json"))
    saved = again.vocab_size if again == MODEL else -1
    again.add_tokens(["view"])
    found = [MODEL.vocab_size, MODEL.num_merges, MODEL.dot_token_id, MODEL.pad_token_id, MODEL.bos_token_id, MODEL.eos_token_id, MODEL.unk_token_id, MODEL.num_additional_tokens, f"{empty.shape} {empty.dtype}", FragmentTokenizer().vocab_size, FragmentTokenizer().num_merges, saved, again.num_additional_tokens]
    return spark.createDataFrame([(name, str(v)) for (name, _), v in zip(_FACTS, found)], "fact string, value string")


@query(_sql("nation", "n_nationkey", [(s, True) for s, *_ in MOLECULES if _[0] is not None][:6] + [(s, False) for s in REJECTED[:3]], "smiles, ok", "DISTINCT smiles, NOT ok AS raised"))
def strict_errors(spark, sf_dir):
    """Which strings raise an error where encoding is strict?"""
    strings = [s for s, *_ in MOLECULES if _[0] is not None][:6] + REJECTED[:3]
    rows = []
    for text in strings:
        one = spark.createDataFrame([(text,)], "smiles string").select(safe_encode("smiles", strict=True).alias("safe"))
        try:
            one.collect()
            rows.append((text, False))
        except Exception as e:
            if "Invalid SMILES" not in str(e):
                raise
            rows.append((text, True))
    return spark.createDataFrame(rows, "smiles string, raised boolean")


@query("SELECT CAST(('0x' || x)::INT AS INT) AS byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents) GROUP BY 1")
def byte_tokens(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.explode(tk.tokens_of(tk.byte_word(F.col("text")))).alias("byte"))
    return ids.groupBy("byte").agg(F.count("*").alias("n"))


_PAIRS = "SELECT substr(w, CAST(i AS INT), 2) AS pair, sum(n) AS n FROM {0}, unnest(range(1, length(w))) r(i) GROUP BY 1"
_TOP = "SELECT pair FROM ({0}) ORDER BY n DESC, unicode(pair), unicode(substr(pair, 2, 1)) LIMIT 1"


@query(f"WITH words AS (SELECT {_BYTES.format('p_name')} AS w, count(*) AS n FROM part GROUP BY 1) SELECT unicode(pair) AS left_id, unicode(substr(pair, 2, 1)) AS right_id, CAST(n AS BIGINT) AS n FROM ({_PAIRS.format('words')}) ORDER BY n DESC, 1, 2 LIMIT 20")
def pair_counts_top(spark, sf_dir):
    """The 20 most frequent byte pairs of part names."""
    words = table(spark, sf_dir, "part").groupBy(tk.byte_word(F.col("p_name")).alias("word")).agg(F.count("*").alias("n"))
    top = tk.pair_counts(words).select(F.ascii("pair").alias("left_id"), F.ascii(F.substring("pair", 2, 1)).alias("right_id"), "n")
    return top.orderBy(F.col("n").desc(), "left_id", "right_id").limit(20)


def _training_sql(steps: int) -> str:
    ctes = [f"w0 AS (SELECT {_BYTES.format('p_name')} AS w, count(*) AS n FROM part GROUP BY 1)"]
    for i in range(steps):
        ctes.append(f"m{i} AS ({_TOP.format(_PAIRS.format(f'w{i}'))})")
        ctes.append(f"w{i + 1} AS MATERIALIZED (SELECT replace(w, pair, chr({256 + i})) AS w, n FROM w{i}, m{i})")
    picks = " UNION ALL ".join(f"SELECT {i} AS rank, unicode(pair) AS left_id, unicode(substr(pair, 2, 1)) AS right_id, {256 + i} AS new_id FROM m{i}" for i in range(steps))
    return f"WITH {', '.join(ctes)} {picks}"


@query(_training_sql(8))
def bpe_train_8(spark, sf_dir):
    """Eight merges over part names, each name one fragment."""
    return BpeTrainer(269, "p_name").fit(table(spark, sf_dir, "part")).merges_table(spark)


@query(_training_sql(12))
def bpe_train_incremental(spark, sf_dir):
    """Twelve merges over part names by rounds on Spark, which read and rewrite what their merges touch."""
    return BpeTrainer(273, "p_name", local_limit=0).fit(table(spark, sf_dir, "part")).merges_table(spark)


@query(_training_sql(4).replace("FROM part", "FROM (SELECT n_name AS p_name FROM nation)"))
def bpe_train_iterator(spark, sf_dir):
    """Four merges over the nations' names, by an iterator."""
    names = table(spark, sf_dir, "nation").select("n_name").toLocalIterator()
    return train_from_iterator(spark, (r["n_name"] for r in names), 265).merges_table(spark)


@query(f"SELECT doc_id, len(ids) AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5 FROM (SELECT doc_id, {_sql_ids('text')} AS ids FROM documents)")
def bpe_encode_documents(spark, sf_dir):
    """Token ids of whole documents as single fragments."""
    ids = table(spark, sf_dir, "documents").select("doc_id", MODEL.fragment_ids(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_md5"))


@query(f"SELECT n_ids, count(*) AS n FROM (SELECT len({_sql_ids('p_name')}) AS n_ids FROM part) GROUP BY 1")
def token_lengths(spark, sf_dir):
    lengths = table(spark, sf_dir, "part").select(F.size(MODEL.fragment_ids(F.col("p_name"))).cast("long").alias("n_ids"))
    return lengths.groupBy("n_ids").agg(F.count("*").alias("n"))


def _vocab_sql() -> str:
    vocab = MODEL.get_vocab()
    merged = values([(i, vocab[i].decode(), "merge") for i in range(256, 256 + MODEL.num_merges)], "m(id, t, kind)")
    special = values([(i, t, "special") for i, t in enumerate((".", "<pad>", "<bos>", "<eos>", "<unk>"), 256 + MODEL.num_merges)], "s(id, t, kind)")
    more = values([(i, t, "additional") for i, t in enumerate(MODEL.additional, 261 + MODEL.num_merges)], "a(id, t, kind)")
    rest = " UNION ALL ".join(f"SELECT id, upper(hex(encode(t))) AS bytes_hex, kind FROM {x}" for x in (merged, special, more))
    return f"SELECT CAST(i AS INT) AS id, upper(format('{{:02x}}', i)) AS bytes_hex, 'byte' AS kind FROM range(0, 256) r(i) UNION ALL {rest}"


@query(_vocab_sql())
def vocab_table(spark, sf_dir):
    return MODEL.vocab_table(spark).select("id", F.hex("bytes").alias("bytes_hex"), "kind")


_B, _E, _P = MODEL.bos_token_id, MODEL.eos_token_id, MODEL.pad_token_id
_LIST = "array_to_string({0}, ' ') AS ids"


def _names(spark, sf_dir, **how) -> DataFrame:
    """c_name as one fragment each: the names are no molecules."""
    out = MODEL.encode_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", **how)
    return out.select("c_custkey", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"SELECT c_custkey, {_LIST.format(f'list_concat(list_concat([{_B}], {_sql_ids("c_name")}), [{_E}])')} FROM customer")
def special_wrap(spark, sf_dir):
    return _names(spark, sf_dir, add_special_tokens=True)


@query(f"SELECT c_custkey, {_LIST.format(f'list_concat(list_concat([{_B}], list_slice({_sql_ids("c_name")}, 1, 6)), [{_E}])')} FROM customer")
def truncate_pad(spark, sf_dir):
    return _names(spark, sf_dir, add_special_tokens=True, max_length=8, pad=True)


@query(f"WITH e AS (SELECT c_custkey, {_sql_ids('c_name')} AS x FROM customer), l AS (SELECT max(len(x)) AS n FROM e) SELECT c_custkey, {_LIST.format(f'list_concat(x, list_transform(range(0, n - len(x)), lambda i: {_P}))')} FROM e, l")
def pad_to_longest(spark, sf_dir):
    return _names(spark, sf_dir, pad=True)


@query(f"SELECT event_type, count(*) AS n, any_value({_LIST.format(f"CASE event_type WHEN 'click' THEN [{_P + 4}] WHEN 'view' THEN [{_P + 5}] WHEN 'purchase' THEN [{_P + 6}] ELSE {_sql_ids('event_type')} END").removesuffix(' AS ids')}) AS ids FROM events GROUP BY 1")
def additional_tokens(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    out = MODEL.encode_table(kinds, "event_type")
    return out.select("event_type", "n", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def decode_roundtrip(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id", MODEL.fragment_ids(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.md5(MODEL.decoded(F.col("ids"))).alias("text_md5"))


@query("SELECT p_partkey, p_name AS decoded FROM part")
def decode_skip_unknown(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select("p_partkey", MODEL.fragment_ids(F.col("p_name")).alias("ids"))
    odd = F.concat(F.array(F.lit(10**6)), F.col("ids"), F.array(F.lit(MODEL.vocab_size), F.lit(-1)))
    return ids.select("p_partkey", MODEL.decoded(odd).alias("decoded"))


@query(_sql("supplier", "s_suppkey", [g for g in _GOLD if g[1]], "smiles, safe", "s_suppkey, array_to_string(list_sort(string_split(safe, '.')), '.') AS fragments"))
def shuffled_fragments(spark, sf_dir):
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", [(g[0],) for g in _GOLD if g[1]], "smiles string")
    mixed = rows.withColumn("fragments", F.shuffle(safe_fragments("smiles"), F.lit(7)))
    return mixed.select("s_suppkey", F.array_join(F.array_sort("fragments"), ".").alias("fragments"))


@query("SELECT count(*) AS n, count(*) AS n_ok, CAST(1.0 AS DOUBLE) AS accuracy FROM orders")
def roundtrip_accuracy(spark, sf_dir):
    rows = keyed(spark, sf_dir, "orders", "o_orderkey", _STRINGS, "smiles string")
    return evaluate.accuracy(evaluate.round_trips(rows, MODEL))


@query(_sql("orders", "o_orderkey", SAME, "one, other, same", "o_orderkey, same"))
def same_molecule(spark, sf_dir):
    """Renumbered and changed molecules, told apart by their graphs; each pair of strings once."""
    rows = keyed(spark, sf_dir, "orders", "o_orderkey", [s[:2] for s in SAME], "one string, other string")
    pairs = isomorphism.same_molecules(rows.select("one", "other").distinct(), "one", "other")
    return rows.join(F.broadcast(pairs), ["one", "other"]).select("o_orderkey", "same")  # at most the fixture's pairs


_TRIPS = [(m[0],) for m in MOLECULES] + [(m[0],) for m in MARKED]


@query(_sql("orders", "o_orderkey", [(s, s not in CHANGED) for (s,) in _TRIPS], "smiles, ok", "count(*) AS n, sum(ok::INT)::BIGINT AS n_ok, avg(ok::INT) AS accuracy"))
def molecule_accuracy(spark, sf_dir):
    """How many molecules come back from encoding and decoding as the molecules they were?"""
    rows = keyed(spark, sf_dir, "orders", "o_orderkey", _TRIPS, "smiles string")
    return evaluate.accuracy(evaluate.round_trips(rows, MODEL, compare="molecules"))


_READER = FragmentTokenizer(MODEL.merges, ["tap", "view", "purchase"])


@query("SELECT event_id, 'click' AS input, 'tap' AS decoded FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 10")
def first_failures(spark, sf_dir):
    """The first ten of the events that a reader with another name for one token gets wrong."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("smiles"))
    return evaluate.first_failures(evaluate.round_trips(rows, MODEL, reader=_READER), "event_id")


@query("SELECT count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END)::BIGINT AS n_ok, avg(CASE WHEN event_type = 'click' THEN 0.0 ELSE 1.0 END) AS accuracy FROM events")
def reader_accuracy(spark, sf_dir):
    """The share of events that this reader gets right."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("smiles"))
    return evaluate.accuracy(evaluate.round_trips(rows, MODEL, reader=_READER))


@query("SELECT event_type AS input, CASE event_type WHEN 'click' THEN 'tap' END AS decoded, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2")
def roundtrip_failures(spark, sf_dir):
    """All failures as written to CSV and read again, counted."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("smiles"))
    path = shared_file(spark, "failures")
    sources.write_failures(evaluate.failures(evaluate.round_trips(rows, MODEL, reader=_READER)), path)
    return spark.read.csv(path, header=True).groupBy("input", "decoded").agg(F.count("*").alias("n"))


@query("SELECT CAST(1.0 AS DOUBLE) AS accuracy")
def command_line(spark, sf_dir):
    """python -m fragmill on a CSV file of the fixture's strings."""
    from fragmill.__main__ import main

    path = shared_file(spark, "strings")
    spark.createDataFrame([(m[0],) for m in MOLECULES if m[0]], "smiles string").coalesce(1).write.csv(path, header=True)
    return spark.createDataFrame([(main([path, "--train-n", "10", "--vocab-size", "270", "--compare", "strings"]),)], "accuracy double")


@query(_sql("customer", "c_custkey", _GOLD, "smiles, safe", "c_custkey, safe"))
def stream_encode(spark, sf_dir):
    """Customers as a bounded stream, encoded batch by batch and written out."""
    at = shared_file(spark, "stream")
    path = f"{sf_dir}/customer.parquet"
    stored = spark.read.parquet(path)
    source = spark.readStream.schema(stored.schema)
    if all(f.endswith("/customer.parquet") for f in stored.inputFiles()):  # one file: a stream reads its folder
        stream = source.option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    else:
        stream = source.parquet(path)
    fix = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MOLECULES)], "fix_id long, smiles string")
    rows = stream.select("c_custkey", F.pmod("c_custkey", F.lit(len(MOLECULES))).alias("fix_id")).join(F.broadcast(fix), "fix_id")
    out = encoded(rows).select("c_custkey", "safe")
    run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
