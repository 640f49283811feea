"""Every query against its SQL on the smallest tables, and unit cases of functions and operators."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone import catalog
from marlstone.functions import text as T
from marlstone.operators import fill, match, measures, records
from marlstone.plans import screening
from tests.conftest import DATA


def _canon(frame):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return float(v) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        assert _canon(got) == _canon(duck.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got)


def test_contract(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("sid", "acid", "seq", "want"),
    [
        ("BC", "", "", "pristine"), ("BC-HNO3", "", "", "acid"), ("BC-KOH", "", "", "other"), ("", "", "", "unknown"), ("APBC", "HCl", "", "other"),
        ("X", "", "neutralization", "unknown"), ("Hydrochar (Wang et al., 2010)", "HCl", "", "other"), ("S1", "lemon juice", "", "acid"), ("S2", None, "", "unknown"),
        ("Qmax", "", "", "other"), ("B1", "", "aminated with HCl", "other"), ("B2", "", "activated", "other"),
    ],
)
def test_sample_class(spark, sid, acid, seq, want):
    assert _one(spark, screening.classify_sample(F.col("a"), F.col("b"), F.col("c")), a=sid, b=acid, c=seq) == want


def test_keys(spark):
    for name in ("Foo-2020-main.pdf", "Foo-2020-mmc1.docx", "dir/foo_2020 SI.pdf"):
        assert _one(spark, T.paper_key(F.col("a")), a=name) == "foo 2020"
    assert _one(spark, T.is_supplement(F.col("a")), a="Foo-2020-mmc1.docx") and not _one(spark, T.is_supplement(F.col("a")), a="Foo-2020.pdf")
    assert _one(spark, T.sample_key(F.col("a")), a="bc-2.5 (x)") == "BC-2.5X"
    assert _one(spark, T.key_matches(F.col("a"), "sheet1"), a="Sheet1_2") and not _one(spark, T.key_matches(F.col("a"), "sheet1"), a="sheet12")


def test_scalars(spark):
    assert _one(spark, T.first_number(F.col("a")), a="about -1,200.5 units") == "-1200.5"
    assert _one(spark, T.dedupe_scalar(F.col("a")), a="7  7 7") == "7"
    assert _one(spark, T.find_doi(F.col("a")), a="see doi:10.1000/abc.def). Then") == "10.1000/abc.def"
    assert _one(spark, T.guess_title(F.col("a")), a="Abstract of it\n\nA title of more than five words here\nx") == "A title of more than five words here"
    assert _one(spark, T.strip_tail(F.col("a")), a="body " * 20 + "References [1]") == "body " * 20
    assert _one(spark, T.strip_tail(F.col("a")), a="References first " + "body " * 20).startswith("References")
    assert abs(_one(spark, T.chi2_survival(F.col("a"), 1), a=10.788) - 0.00102186) < 1e-6
    assert abs(_one(spark, T.chi2_survival(F.col("a"), 2), a=2.0) - np.exp(-1)) < 1e-12
    assert _one(spark, T.is_missing(F.col("a")), a=" N/A ") and not _one(spark, T.is_blank(F.col("a")), a=" N/A ")


def test_recipe_in_neighbouring_sentences(spark):
    text = "Biochar was treated with HCl in preparation. HCl 2 M was used for 3 h."
    flags = screening.sentence_flags(T.sentences(F.col("a")), F.lower("a"))
    assert _one(spark, screening.adjacent_pairs(flags), a=text) >= 1


def test_strict_profile_passes_a_full_paper(spark):
    text = (
        "Biochar for heavy metal removal. Materials and methods: pyrolysis of feedstock. Biochar was prepared and treated with HCl 2 M for 3 h. "
        "BET surface area and pore volume. Initial concentration and solution pH. Langmuir qmax 12 mg/g. Table 1. Table 2. Uranium and lead uptake in wastewater. "
    ) + "Filler sentence without meaning. " * 120
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    for profile in screening.PROFILES:
        out = {r["doc_id"]: r for r in screening.screen(docs, profile).collect()}
        assert out[1]["status"] == "PASS", (profile, out[1]["reason"])
        assert out[2]["status"] == "FAIL" and out[2]["scanned_suspect"]
    assert "uranium" in out[1]["matched_radionuclide"]


def test_fills_never_overwrite(spark):
    rows = [("p", 1, "a"), ("p", 2, None), ("q", 3, "a"), ("q", 4, "b"), ("q", 5, None), (None, 6, "z"), (None, 7, None)]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    assert {r["i"]: r["v"] for r in fill.fill_unique(df, ["k"], ["v"]).collect()} == {1: "a", 2: "a", 3: "a", 4: "b", 5: None, 6: "z", 7: "z"}
    many = spark.createDataFrame([("p", "1"), ("p", "1"), ("p", "2"), ("p", "2"), ("q", "1"), ("q", "1"), ("q", "2"), ("r", None)], "k string, v string")
    assert {r["k"]: r["m"] for r in fill.strict_mode(many, ["k"], "v", "m").collect()} == {"p": None, "q": "1", "r": None}


def test_greedy_merge_and_collapse(spark):
    rows = [("P", "BC-HCl", "100", None, None, 1), ("P", "BC-HCl", None, "3", None, 2), ("P", "BC-HCl", "120", None, "5", 3)]
    df = spark.createDataFrame(rows, "paper string, sid string, ssa string, aps string, pzc string, ord int")
    merged = sorted((r["ssa"], r["aps"], r["pzc"]) for r in records.greedy_merge(df, "paper", ["sid"], ["ssa", "aps", "pzc"], "ord").collect())
    assert merged == [("100", "3", "5"), ("120", None, "5")] or merged == [("100", "3", None), ("120", None, "5")]
    one = records.collapse(df, ["paper", "sid"], ["ssa", "aps", "pzc"], "ord").first()
    assert (one["aps"], one["pzc"], one["merged_rows"]) == ("3", "5", 3)
    blank = spark.createDataFrame([("P", "S", "1", "2", 1), ("P", None, "1", None, 2), ("P", None, "1", "2", 3)], "paper string, sid string, a string, b string, ord int")
    assert sorted(r["merged_rows"] for r in records.greedy_merge(blank, "paper", ["sid"], ["a", "b"], "ord").collect()) == [1, 2]


def test_validated_joins_raise(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="repeats a key"):
        match.join_many_to_one(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="one to one"):
        match.join_one_to_one(left, right.dropDuplicates(["k"]), ["k"]).collect()


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=300) * (1 + abs(x[:, 0]))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    fit = measures.least_squares(df, {"a": F.col("a"), "b": F.col("b")}, "y")
    d = np.column_stack([np.ones(300), x])
    inv = np.linalg.inv(d.T @ d)
    beta = inv @ d.T @ y
    e, h = y - d @ beta, np.einsum("ij,jk,ik->i", d, inv, d)
    hc3 = np.sqrt(np.diag(inv @ (d * ((e / (1 - h)) ** 2)[:, None]).T @ d @ inv))
    assert np.allclose(fit.beta, beta) and np.allclose(fit.errors, hc3) and fit.rows == 300 and fit.residual_df == 297
    loss = measures.drop_one_block(df, {"first": {"a": F.col("a")}, "second": {"b": F.col("b")}}, "y")
    assert loss["first"] > loss["second"] > 0


def test_spline_is_linear_outside(spark):
    xs = spark.createDataFrame([(float(v),) for v in (0, 1, 10, 11, 12)], "x double")
    got = [r[0] for r in xs.select(measures.spline_basis(F.col("x"), [2.0, 5.0, 9.0])[0]).collect()]
    assert got[:2] == [0, 0] and got[3] - got[2] == pytest.approx(got[4] - got[3])


def test_constant_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "k string, v double")
    assert {r["v"] for r in measures.min_max(df, ["v"], ["k"]).collect()} == {0.5}
    assert {r["z"] for r in measures.z_score(df, "v", "z", ["k"]).collect()} == {None}
    with pytest.raises(Exception, match="constant"):
        measures.z_score(df, "v", "z", ["k"], "raise").collect()
