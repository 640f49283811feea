import json

import pytest
from pyspark.sql import functions as F

from marlstone.agents import replies, seam
from marlstone.operators import resample
from marlstone.plans import export
from marlstone.streaming import ingest


def test_replies():
    assert replies.parse_reply('```json\n{"a": [1, 2]}\n```') == {"a": [1, 2]}
    assert replies.parse_reply("Output: ['x', 'y']") == ["x", "y"]
    assert replies.parse_reply('Well, {"not closed" but then [{"b": "]"}] ends') == [{"b": "]"}]
    with pytest.raises(ValueError):
        replies.parse_reply("nothing (here")
    assert replies.labels_of("Property, synthesis_condition\nunknown") == ["property", "synthesis condition"] and replies.labels_of(None) == ["else"]
    assert replies.names_of([["Surface Area", None], "pore-volume", "surface area"]) == ["surface_area", "pore_volume"]


def test_seam_asks_once_and_keeps(spark):
    rows = [(1, "about BC"), (2, "about BC"), (3, "broken"), (4, None)]
    df = spark.createDataFrame(rows, "id long, prompt string")
    backend = seam.Fallback(seam.Canned({"BC": '[{"sample_id": "BC"}]', "broken": "no value"}), seam.Canned({}))
    out = seam.ask(df, "id", "prompt", backend).cache()
    assert {r["id"]: (r["value"], r["error"] is None) for r in out.collect()} == {1: ('[{"sample_id": "BC"}]', True), 2: ('[{"sample_id": "BC"}]', True), 3: (None, False)}
    assert [(r["id"], r["row"]) for r in seam.records_of(out, "id").orderBy("id").collect()] == [(1, {"sample_id": "BC"}), (2, {"sample_id": "BC"})]

    def fails(prompt):
        raise RuntimeError("must not be asked")

    assert seam.ask(df, "id", "prompt", fails, kept=out).where("error like 'Runtime%'").count() == 0


def test_pack(spark):
    df = spark.createDataFrame([(1, i, "x" * 40) for i in range(1, 6)], "doc long, o int, t string")
    assert [(r["first"], r["last"], r["tokens"]) for r in seam.pack(df, "doc", "o", "t", 20).orderBy("pack").collect()] == [(1, 2, 20), (3, 4, 20), (5, 5, 10)]


def test_export(spark):
    m = [
        ("Foo-2020-main.pdf", 1, {"sample_id": "BC-HCl", "acid_type": "HCl", "acid_conc_mol_L": "1 M", "SSA_m2_g": "100 100"}), ("Foo-2020-mmc1.docx", 2, {"sample_id": "bc-hcl", "PV_cm3_g": "0.3"}),
        ("Foo-2020-main.pdf", 3, {"sample_id": "BC", "pyrolysis_temp_C": "500", "acid_type": "HCl"}), ("Foo-2020-main.pdf", 4, {"sample_id": "BC-KOH", "SSA_m2_g": "9"}), ("Foo-2020-main.pdf", 5, {"sample_id": "U(VI)", "SSA_m2_g": "7"}),
    ]
    a = [("Foo-2020-main.pdf", 1, {"sample_id": "BC-HCl", "pollutant_name": "U(VI)", "T_K": "25 °C", "pH": "5"}), ("Foo-2020-main.pdf", 2, {"sample_id": "BC-HCl", "pollutant_name": "U(VI)", "pH": "6", "Qmax": "12"})]
    schema = "filename string, ord long, row map<string, string>"
    materials, adsorption = export.export_tables(spark.createDataFrame(m, schema), spark.createDataFrame(a, schema))
    rows = {r["sample_id"]: r.asDict() for r in materials.collect()}
    assert set(rows) == {"BC-HCl", "BC"}
    assert (rows["BC-HCl"]["filename"], rows["BC-HCl"]["SSA_m2_g"], rows["BC-HCl"]["TPV_cm3_g"], rows["BC-HCl"]["acid_conc_mol_L"], rows["BC-HCl"]["pyrolysis_temp_C"]) == ("Foo-2020-main.pdf", "100", "0.3", "1", "500")
    assert rows["BC"]["acid_type"] is None
    assert sorted((r["pH"], r["T_K"], r["Qmax"]) for r in adsorption.collect()) == [("5", "298.15", None), ("6", "298.15", "12")]


def test_export_keeps_measurements_without_a_sample(spark):
    rows = [("Foo-2020-main.pdf", i, {"pollutant_name": "U(VI)", "T_K": t, "Qmax": q}) for i, (t, q) in enumerate([("298 K", "12"), (None, "34"), (None, "34")])]
    schema = "filename string, ord long, row map<string, string>"
    # two samples: a file's only sample would name its rows
    m = [("Foo-2020-main.pdf", 1, {"sample_id": "BC-HCl", "acid_type": "HCl"}), ("Foo-2020-main.pdf", 2, {"sample_id": "BC-HNO3", "acid_type": "HNO3"})]
    _, adsorption = export.export_tables(spark.createDataFrame(m, schema), spark.createDataFrame(rows, schema))
    assert sorted((r["Qmax"], r["T_K"] or "") for r in adsorption.collect()) == [("12", "298"), ("34", ""), ("34", "")]


def test_bootstrap_query_against_brute_force(spark, tmp_path):
    import numpy as np

    from marlstone import catalog

    rows = [(u, "ab"[(u + i) % 2], float(u * 3 + i * i % 7)) for u in range(9) for i in range(1 + u % 4)] + [(1, "a", None), (3, "c", 1.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_type"]: r for r in catalog.QUERIES["cluster_bootstrap_interval"](spark, str(tmp_path)).collect()}
    draws = spark.range(9).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(999))).alias("r")).withColumn("w", resample.poisson_weight(F.col("u"), F.col("r"), 1009))
    weight = np.zeros((9, 1000))
    for d in draws.collect():
        weight[d["u"], d["r"]] = d["w"]
    assert set(got) == {"a", "b", "c"} and len(set(weight.ravel())) > 3
    for kind in "abc":
        own = [(u, v) for u, k, v in rows if k == kind and v is not None]
        drawn = sum(weight[u] for u, _ in own)
        means = (sum(weight[u] * v for u, v in own)[drawn > 0]) / drawn[drawn > 0]
        r = got[kind]
        assert (r["n"], r["clusters"], r["replicas"]) == (len(own), len({u for u, _ in own}), len(means))
        if len(means) >= 700:
            assert np.allclose([r["mean"], r["low"], r["high"]], [np.mean([v for _, v in own]), *np.percentile(means, [2.5, 97.5])])
        else:
            assert r["low"] is None and r["high"] is None


def test_bootstrap(spark):
    df = spark.range(2000).select((F.col("id") % 40).alias("c"), (F.col("id") % 2).alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    rows = resample.cluster_bootstrap(df, "c", ["k"], "v", 200).collect()
    assert len(rows) == 2 and all(r["low"] <= r["mean"] <= r["high"] and r["clusters"] == 20 for r in rows)


def test_stream_goes_on_where_it_stood(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in (1, 2):
        (src / f"{n}.json").write_text(json.dumps({"doc_id": n, "text": "short"}))
        ingest.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_targets_by_paper_by_all_papers_by_context_and_by_family(spark):
    fields = "paper string, sample_id string, acid_type string, modification_sequence string"
    m = [("p", "SC", "HNO3", None), ("p", "NSC", "KOH", None), ("p", "NNSC", "KOH", None), ("p", "HMB", "KOH", None), ("p", None, "HCl", None), ("p", None, None, None), ("q", "ZC", "HCl", None), ("r", "OB", "KOH", None)]
    a = [("p", "SC"), ("p", "nsc"), ("p", "SC-2"), ("p", "MB"), ("p", "HMB"), ("p", None), ("q", None), ("r", "ZC"), ("r", "thing-KOH"), ("r", None), ("s", "BC-HNO3")]
    from marlstone.plans import export

    kept, stay = export.keep_targets(spark.createDataFrame(m, fields), spark.createDataFrame(a, "paper string, sample_id string"))
    assert sorted((r.paper, r.sample_id or "") for r in kept.collect()) == [("p", ""), ("p", "NNSC"), ("p", "NSC"), ("p", "SC"), ("q", "ZC")]
    # HMB is known as another class, so MB is its untreated material; a blank row stays where the paper has one class
    assert sorted((r.paper, r.sample_id or "") for r in stay.collect()) == [("p", ""), ("p", "MB"), ("p", "SC"), ("p", "SC-2"), ("p", "nsc"), ("q", ""), ("r", "ZC"), ("s", "BC-HNO3")]


def test_aliases_of_adsorption_rows(spark):
    from marlstone.plans import export

    m = spark.createDataFrame([("p", "BC-Mg", 1), ("p", "BC", 2)], "paper string, sample_id string, ord int")
    a = spark.createDataFrame([("p", "bc modified with mg", 5), ("p", "b c", 6), ("p", None, 7), ("q", "bc modified with mg", 8)], "paper string, sample_id string, ord int")
    assert {r.ord: r.sample_id for r in export.alias_ids(a, m).collect()} == {5: "BC-Mg", 6: "BC", 7: None, 8: "bc modified with mg"}
