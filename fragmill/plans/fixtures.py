"""Molecules with known results, for queries and tests: no driver table holds molecule strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# String, encoded string (None: no molecule), number of cut bonds.
MOLECULES: list[tuple[str, str | None, int]] = [
    ("Cc1ccc(-c2cc(C(F)(F)F)nn2-c2ccc(S(N)(=O)=O)cc2)cc1", "c15ccc(cc1)S(N)(=O)=O.Cc1ccc3cc1.c13n5nc4c1.C4(F)(F)F", 3),
    ("CCCOCC", "CCC1.O12.C2C", 2),
    ("CCCOCCC(=O)c1ccccc1", "c14ccccc1.C3CC4=O.CCC2.O23", 3),
    ("O=C(CN1CC[NH2+]CC1)N1CCCCC1", "N12CC[NH2+]CC1.N13CCCCC1.O=C3C2", 2),
    ("[NH3+]Cc1ccccc1", "c12ccccc1.[NH3+]C2", 1),
    ("c1ccc(-c2ccccc2)cc1", "c1ccc3cc1.c13ccccc1", 1),
    ("CC(C)Cc1ccc(C(C)C(=O)O)cc1", "c12ccc3cc1.C3(C)C(=O)O.CC(C)C2", 2),
    ("CC(CS)C(=O)N1CCCC1C(=O)O", "CC(CS)C2=O.N12C3CCC1.C3(=O)O", 2),
    ("CCO", "CCO", 0),
    ("OCC", "CCO", 0),
    ("c1ccccc1", "c1ccccc1", 0),
    ("C(=O)O", "C(=O)O", 0),
    ("*C", "[1*]C", 0),
    ("[CH4]", "C", 0),
    ("[Cl-].[Na+]", "[Na+].[Cl-]", 0),
    ("CC)C", "C.CC", 0),
    ("C1C1", "C1", 0),
    ("CSi", "C[Si]", 0),
    ("", "", 0),
    ("C1CCC", None, 0),
    ("C[C@H](C1=C(F)C=C(C", None, 0),
    ("not_a_smiles???", None, 0),
    ("C(C", None, 0),
]
# String, scaffold before numbering, after.
SCAFFOLDS = [
    ("CCCOCC", "CCC[1*].O([1*])[2*].C([2*])C", "CCC1.O12.C2C"),
    ("CCCOCCC(=O)c1ccccc1", "c1([3*])ccccc1.C([2*])CC([3*])=O.CCC[1*].O([1*])[2*]", "c14ccccc1.C3CC4=O.CCC2.O23"),
    ("CC(CS)C(=O)N1CCCC1C(=O)O", "CC(CS)C([1*])=O.N1([1*])C([2*])CCC1.C([2*])(=O)O", "CC(CS)C2=O.N12C3CCC1.C3(=O)O"),
]
# Accepted and rejected strings.
ACCEPTED = ["c1ccccc1", "C(=O)O", "CC(C)C", "CC)C", "CC=", "C(C.C", "C11", "CSi", "", "on", "Is"]
REJECTED = ["C1CCC", "C[C@H](C1=C(F)C=C(C", "not_a_smiles???", "not_valid", "C(C", "1CC", "C%1", "C C", "[Co]", "[CH10]", "[se]", "C$C"]


# Strings with marks of chirality and direction, isotopes, maps, charges, written hydrogens and ring
# numbers from 10 on, and the encoded string.
MARKED: list[tuple[str, str]] = [
    ("N[C@@H](C)C(=O)O", "C[C@@H](C(=O)O)N"),
    ("C[C@H](N)C(=O)O", "C[C@@H](C(=O)O)N"),
    ("OC(=O)[C@@H](N)C", "C[C@@H](C(=O)O)N"),
    ("N[C@H](C)C(=O)O", "C[C@H](C(=O)O)N"),
    ("[H][C@@](C)(N)C(=O)O", "[H][C@](C)(C(=O)O)N"),
    ("C[C@@](F)(Cl)Br", "C[C@@](F)(Cl)Br"),
    ("C[C@](F)(Br)Cl", "C[C@@](F)(Cl)Br"),
    ("C[C@H]1CCCO1", "C1C[C@@H](OC1)C"),
    ("C[C@@H]1OCCC1", "C1C[C@@H](OC1)C"),
    ("CN1CC[C@H](O)C1", "N1(CC[C@@H](C1)O)C"),
    ("C[S@](=O)CC", "[S@@](C)(CC)=O"),
    ("F/C=C/F", "F/C=1.C=1/F"),
    ("F/C=C\\F", "F/C=1.C=1\\F"),
    ("C(\\F)=C/F", "C=1\\F.C=1/F"),
    ("C1CC/C=C/CCC1", "C1CCC\\C=C\\CC1"),
    ("C1CC/C=C\\CCC1", "C1CCC/C=C\\CC1"),
    ("[13CH3]C", "C[13CH3]"),
    ("[2H]C([2H])[2H]", "[2H]C([2H])[2H]"),
    ("CC[CH2:1][OH:2]", "CC[CH2:1][OH:2]"),
    ("[13C]1CCCCC1C[238U]C[NH3+]", "[13C]1CCCCC12.C2[238U]C[NH3+]"),
    ("COC[CH2:1][CH2:2]O[CH:2]C[OH:3]", "C1[CH2:1][CH2:2]2.[CH:2]3C[OH:3].CO1.O23"),
    ("[O-][n+]1ccccc1", "[n+]1([O-])ccccc1"),
    ("[nH]1cccc1", "c1cc[nH]c1"),
    ("[Fe+2]", "[Fe+2]"),
    ("[CH3-]", "[CH3-]"),
    ("C=1CCCCC1", "C1=CCCCC1"),
    ("C1CCCCC=1", "C1=CCCCC1"),
    ("COC%10CCCC%10", "C1%11CCCC1.CO%11"),
    ("CCOCCOCCOCCOCCOCC", "C3C4.C5C6.C7C8.C9C%10.CC1.O13.O45.O67.O89.O%102.C2C"),
]
# String, and the string written without cuts.
WRITTEN: list[tuple[str, str]] = [
    ("F/C=C/F", "C(=C/F)\\F"),
    ("F/C=C\\F", "C(=C\\F)\\F"),
    ("C(\\F)=C/F", "C(=C/F)\\F"),
    ("COC%10CCCC%10", "C1CCC(C1)OC"),
    ("C1234C567C89%10C%11%12%13C1C5C8C%11C2C6C9C%12C3C7C%10C4%13", "C359%12C26%10C17%11C48%13C(C1C2C34)C5C6C7C8C9C%10C%11C%12%13"),
]
# A molecule for each rule of the table, by its environments.
RULES: list[tuple[str, str, str]] = [
    ("acyl", "ether_o", "CC(=O)OC1CC1"),
    ("acyl", "amine_n", "CC(=O)N(C)C"),
    ("acyl", "ring_amide_n", "CC(=O)N1CCCC1=O"),
    ("ether_o", "sp3_c", "CCOC"),
    ("ether_o", "hetero_ring_c", "COC1CCCCO1"),
    ("ether_o", "arom_c_hetero", "COc1ccccn1"),
    ("ether_o", "carbo_ring_c", "COC1CCCC1"),
    ("ether_o", "arom_c_ring", "COc1ccccc1"),
    ("sp3_c", "amine_n", "CCNC"),
    ("sp3_c", "thioether_s", "CCSC"),
    ("amine_n", "sulfonyl", "CNS(C)(=O)=O"),
    ("amine_n", "arom_c_hetero", "CNc1ccccn1"),
    ("amine_n", "arom_c_ring", "CNc1ccccc1"),
    ("amine_n", "hetero_ring_c", "CNC1CCCCO1"),
    ("amine_n", "carbo_ring_c", "CNC1CCCC1"),
    ("open_acyl", "hetero_ring_c", "CC(=O)C1CCCCO1"),
    ("open_acyl", "arom_c_hetero", "CC(=O)c1ccccn1"),
    ("open_acyl", "carbo_ring_c", "CC(=O)C1CCCC1"),
    ("open_acyl", "arom_c_ring", "CC(=O)c1ccccc1"),
    ("alkene_c", "alkene_c", "CC=CC"),
    ("open_sp3_c", "arom_n", "CCn1cccc1"),
    ("open_sp3_c", "ring_amide_n", "CCN1CCCC1=O"),
    ("open_sp3_c", "hetero_ring_c", "CCC1CCCCO1"),
    ("open_sp3_c", "arom_c_hetero", "CCc1ccccn1"),
    ("open_sp3_c", "carbo_ring_c", "CCC1CCCC1"),
    ("open_sp3_c", "arom_c_ring", "CCc1ccccc1"),
    ("arom_n", "hetero_ring_c", "c1ccn(C2CCCCO2)c1"),
    ("arom_n", "arom_c_hetero", "c1ccn(-c2ccccn2)c1"),
    ("arom_n", "carbo_ring_c", "c1ccn(C2CCCC2)c1"),
    ("arom_n", "arom_c_ring", "c1ccn(-c2ccccc2)c1"),
    ("ring_amide_n", "hetero_ring_c", "O=C1CCCN1C1CCCCO1"),
    ("ring_amide_n", "arom_c_hetero", "O=C1CCCN1c1ccccn1"),
    ("ring_amide_n", "carbo_ring_c", "O=C1CCCN1C1CCCC1"),
    ("ring_amide_n", "arom_c_ring", "O=C1CCCN1c1ccccc1"),
    ("thioether_s", "hetero_ring_c", "CSC1CCCCO1"),
    ("thioether_s", "arom_c_hetero", "CSc1ccccn1"),
    ("thioether_s", "carbo_ring_c", "CSC1CCCC1"),
    ("thioether_s", "arom_c_ring", "CSc1ccccc1"),
    ("hetero_ring_c", "arom_c_hetero", "C1CCOC1c1ccccn1"),
    ("hetero_ring_c", "carbo_ring_c", "C1CCOC1C1CCCC1"),
    ("hetero_ring_c", "arom_c_ring", "C1CCOC1c1ccccc1"),
    ("arom_c_hetero", "arom_c_hetero", "c1ccnc(-c2ccccn2)c1"),
    ("arom_c_hetero", "carbo_ring_c", "C1CCCC1c1ccccn1"),
    ("arom_c_hetero", "arom_c_ring", "c1ccc(-c2ccccn2)cc1"),
    ("carbo_ring_c", "arom_c_ring", "C1CCCC1c1ccccc1"),
    ("arom_c_ring", "arom_c_ring", "c1ccc(-c2ccccc2)cc1"),
]
# Two strings, and whether they are one molecule; derived by hand, as noted.
SAME: list[tuple[str, str, bool]] = [
    ("OCC", "C(O)C", True),  # renumbered
    ("CCO", "CCN", False),  # another element
    ("CCO", "COC", False),  # same atoms, other bonds
    ("CC(C)CO", "OCC(C)C", True),
    ("CCC(C)O", "CC(C)CO", False),
    ("C1CCCCC1", "C1CC1.C1CC1", False),  # all atoms alike: colours don't decide
    ("C1CCC2CCCCC2C1", "C12CCCCC1CCCC2", True),
    ("C1CCC2CCCCC2C1", "C1CCC(C1)C1CCCC1", False),  # decalin, bicyclopentyl
    ("c1ccccc1-c1ccccc1", "C(c1ccccc1)c1ccccc1", False),  # a carbon between the rings
    ("c1ccccc1-c1ccccc1", "c12ccccc1.c12ccccc1", True),  # a closure joins the rings
    ("[Cl-].[Na+]", "[Na+].[Cl-]", True),
    ("[Cl-].[Na+]", "[Na+].Cl", False),  # another charge, and a hydrogen
    ("[CH4]", "C", True),  # written and implied hydrogens
    ("[13CH3]C", "C[13CH3]", True),
    ("[13CH3]C", "CC", False),
    ("C[CH2:1]O", "CCO", True),  # maps are no part of a molecule
    ("[nH]1cccc1", "c1cc[nH]c1", True),
    ("CC=CC", "CC#CC", False),
    ("N[C@@H](C)C(=O)O", "OC(=O)[C@@H](N)C", True),  # from N: H, C, COOH clockwise; two swaps of neighbours
    ("N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O", False),  # the mirror image
    ("N[C@@H](C)C(=O)O", "N[C@H](C(=O)O)C", True),  # one swap, other mark
    ("C[C@@](F)(Cl)Br", "C[C@](F)(Br)Cl", True),
    ("F/C=C/F", "F\\C=C\\F", True),  # opposite sides, both ways of writing
    ("F/C=C/F", "F/C=C\\F", False),
    ("F/C=C/F", "C(\\F)=C/F", True),  # the first neighbour written behind its atom
    ("F/C=C/F", "FC=CF", False),  # marks lost
    ("C[C@H]1CC[C@@H](C)CC1", "C[C@@H]1CC[C@H](C)CC1", True),  # both centres turned: a mirror plane
    ("C[C@H]1CC[C@@H](C)CC1", "C[C@H]1CC[C@H](C)CC1", False),  # cis and trans
]
# Strings whose encoded form is no longer the molecule, and why; of all strings above.
CHANGED: list[str] = [
    "*C",  # the dummy is written with a label, which reads as an isotope
    "CSi",  # silicon has to be written in brackets, and then has no implied hydrogens
    "C1C1",  # the second bond between two atoms is lost, and with it one end of the closure
]


def molecules(spark: SparkSession) -> DataFrame:
    """mol_id, smiles."""
    return spark.createDataFrame([(i, m[0]) for i, m in enumerate(MOLECULES)], "mol_id long, smiles string")


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A SQL relation with these rows."""
    cell = lambda v: quoted(v) if v is None or isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join(f"({', '.join(map(cell, r))})" for r in rows) + f") AS {names}"
