"""Mining with canned replies, chemical names, material records, packing against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.agents import chemistry, miners, seam


def test_articles_are_mined_by_class(spark):
    rows = [
        (1, 1, "text", "PREP biochar was soaked in HCl 1 M."), (1, 2, "text", "PREP second step, 2 h."), (1, 3, "text", "MEAS qe 12 mg/g of Pb."), (1, 4, "text", "chatter"), (1, 5, "table", '<table id="x"><td>GOOD</td></table>'),
        (1, 6, "table", "ODD"), (2, 1, "text", "BROKEN"), (2, 2, "figure", "f"),
    ]
    df = spark.createDataFrame(rows, "id int, idx int, type string, content string")

    def backend(prompt):
        about = prompt.split("\n")[-1]
        if "BROKEN" in about:
            raise RuntimeError("down")
        if prompt.startswith("Which of these"):
            return "['synthesis condition']" if "PREP" in about else "property" if "MEAS" in about else "else"
        if prompt.startswith("Rewrite"):
            return "| GOOD |" if "GOOD" in about else f"| ODD | {miners.END}"
        if prompt.startswith("Is the table"):
            return "['Property']" if "GOOD" in about else "a poem"
        if prompt.startswith("List"):
            return "['biochar modification']" if "PREP" in about else "none"
        return '[{"sample_id": "A"}]' if "biochar_modification" in prompt.split("Fields")[0] else '{"sample_id": "B", "Qmax": "12"}'

    miner = miners.Miner(backend, second=lambda prompt: f"| GOOD mg/g | {miners.END}")
    out = miners.mine(df, miner).collect()
    got = {(r["id"], r["idx"], r["source"]): (r["kinds"], r["row"], r["error"]) for r in out}
    assert got == {
        (1, 1, "synthesis"): (["biochar_modification"], {"sample_id": "A"}, None), (1, 3, "property"): (["adsorption_experiment"], {"sample_id": "B", "Qmax": "12"}, None),
        (1, 5, "table"): (["adsorption_experiment"], {"sample_id": "B", "Qmax": "12"}, None), (1, 6, "table"): ([], None, "no class of a table: a poem"),
    }
    classes = {(r["id"], r["idx"]): r["classes"] for r in miners.classify(df, miner).collect()}
    assert classes[2, 1] == ["error"] and classes[2, 2] == ["figure"] and classes[1, 4] == ["else"]


def test_kinds_by_words(spark):
    df = spark.createDataFrame([("Biochar at 500",), ("biochar",), ("qe 3",), (None,)], "t string")
    assert [r["k"] for r in df.select(miners.likely_kinds(F.col("t")).alias("k")).collect()] == [["biochar_modification"], [], ["adsorption_experiment"], []]


def test_packs_against_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(d, o, "x" * rng.randint(0, 60), rng.choice("ab")) for d in range(5) for o in range(rng.randint(0, 25))]
    df = spark.createDataFrame(rows, "doc int, o int, t string, k string")
    got = sorted((r["doc"], r["pack"], r["first"], r["last"], r["tokens"], r["text"]) for r in seam.pack(df.repartition(3), "doc", "o", "t", 20, "k").collect())
    want, last = [], None
    for d, o, t, k in rows:
        n = (len(t) + 3) // 4
        if want and want[-1][0] == d and last == k and want[-1][4] + n <= 20:
            w = want[-1]
            want[-1] = (d, w[1], w[2], o, w[4] + n, w[5] + "\n\n" + t)
        else:
            want.append((d, want[-1][1] + 1 if want and want[-1][0] == d else 0, o, o, n, t))
        last = k
    assert got == want


def test_chemical_names():
    assert chemistry.chemical_name("MOF 5") == "5" and chemistry.chemical_name("3 Complex") == "3" and chemistry.chemical_name(None) is None
    assert chemistry.chemical_name("Cu<sub>2</sub>L · 3H2O") == "Cu2L" and chemistry.chemical_name("{ZnL}⋅2H2O") == "{ZnL}"
    assert chemistry.chemical_formula("H₂SO4") == ("H2 O4 S1", True) and chemistry.chemical_formula("(NH4)2") == ("H42 N1", True)
    assert chemistry.chemical_formula("Qx2") == ("Qx2", False) and chemistry.chemical_formula("[Cu]") == ("[Cu]", False) and chemistry.chemical_formula("Unknown") == ("", False) and chemistry.chemical_formula("") == (None, None)


def test_backend_without_stop_is_asked_again():
    def plain(prompt, stop=None):
        if stop:
            raise RuntimeError("Unsupported parameter: 'stop'")
        return prompt.upper()

    assert seam.Stopping(plain, ["END"])("a") == "A" and seam.Stopping(lambda p, stop: f"{p}{stop}", ["x"])("a") == "a['x']"

    def broken(prompt, stop=None):
        raise RuntimeError("no network")

    with pytest.raises(RuntimeError):
        seam.Stopping(broken, ["END"])("a")


def test_packs_by_a_given_counter(spark):
    df = spark.createDataFrame([("d", k, "one two three") for k in range(5)], "doc string, o int, t string")
    got = seam.pack(df, "doc", "o", "t", 6, count=lambda t: len(t.split())).orderBy("pack").collect()
    assert [(r["first"], r["last"], r.tokens) for r in got] == [(0, 1, 6), (2, 3, 6), (4, 4, 3)]
