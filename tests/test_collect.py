"""Collected records against a plain loop over all known materials."""

import random

from marlstone.operators.collect import collect_records
from marlstone.plans.queries_matching import collected_materials, part_records
from tests.conftest import DATA

SCHEMA = "doc string, ord long, name string, symbol string, formula string, source string, general boolean, synonyms array<string>, refcode string, data map<string,string>, elements array<string>"


def plain(rows):
    """Materials of one document by the rules as they stand, comparing each record with every known material."""
    known = []
    for r in sorted(rows, key=lambda r: r["ord"]):
        target = None
        for k in known:
            own = [r["name"], r["symbol"]]
            if k["name"] and k["name"] in own:
                same = k["formula"] == r["formula"] or k["source"] != r["source"]
            else:
                same = bool(k["symbol"]) and k["symbol"] in own
            if same:
                target = k
                break
        if target is None:
            known.append({**r, "material": r["ord"], "records": 1, "data": dict(sorted(r["data"].items())), "elements": list(r["elements"])})
            continue
        if target["name"] and target["name"] == r["symbol"]:
            target["name"] = r["name"] or target["name"]
            target["symbol"] = r["symbol"]
        if r["source"] != "synthesis condition" and r["general"]:
            target["formula"], target["source"] = r["formula"], r["source"]
        if not target["formula"]:
            target["formula"], target["source"] = r["formula"], r["source"]
        for c in ("name", "symbol", "synonyms", "refcode"):
            target[c] = target[c] or r[c]
        for key, value in sorted(r["data"].items()):
            free, n = key, 0
            while free in target["data"]:
                n += 1
                free = f"{key}_{n}"
            target["data"][free] = value
        target["elements"] += r["elements"]
        target["records"] += 1
    return known


def test_random_records(spark):
    rng = random.Random(12)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for doc in ("p", "q", None):
        for k in range(150 if doc == "p" else 40):
            name = pick(None, "", *(f"m{rng.randrange(25)}" for _ in range(5)))
            symbol = pick(None, None, "", *(f"m{rng.randrange(25)}" for _ in range(2)), f"s{rng.randrange(12)}")
            data = {pick("ssa", "ssa_1", "ssa_2", "ph", "ssa_1_1"): str(rng.randrange(99)) for _ in range(rng.randrange(3))}
            rows.append({"doc": doc, "ord": k, "name": name or None, "symbol": symbol or None, "formula": pick(None, "C1", "C2"), "source": pick("text", "table", "synthesis condition"), "general": pick(True, False, False),
                         "synonyms": pick(None, [], ["x"], ["y", "z"]), "refcode": pick(None, None, "R1", "R2"), "data": data, "elements": [f"e{k}"] * rng.randrange(3)})
    table = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    got = sorted(((r.doc or "", r.material, r.records, r["name"], r.symbol, r.formula, r.source, r.synonyms or None, r.refcode or None, dict(r.data), r.elements) for r in collect_records(table).collect()), key=lambda x: x[:2])
    want = []
    for doc in ("p", "q", None):
        for m in plain([r for r in rows if r["doc"] == doc]):
            want.append((doc or "", m["material"], m["records"], m["name"], m["symbol"], m["formula"], m["source"], m["synonyms"] or None, m["refcode"] or None, m["data"], m["elements"]))
    assert got == sorted(want, key=lambda x: x[:2])
    assert max(x[2] for x in got) > 10 and any("ssa_1_1" in x[9] for x in got)


def test_veto_and_empty(spark):
    make = lambda k, formula, source: ("d", k, "A", None, formula, source, False, None, None, {"v": str(k)}, [])
    table = spark.createDataFrame([make(0, "C1", "text"), make(1, "C2", "text"), make(2, "C2", "table"), make(3, "C2", "text")], SCHEMA)
    got = {r.material: dict(r.data) for r in collect_records(table).collect()}
    # the third record comes from another kind of source and joins the first material; the fourth is the second one's
    assert got == {0: {"v": "0", "v_1": "2"}, 1: {"v": "1", "v_1": "3"}}
    assert collect_records(table.where("false")).count() == 0


def test_query_equals_the_plain_version(spark):
    source = [r.asDict() for r in part_records(spark.read.parquet(f"{DATA}/part.parquet")).collect()]
    want = {}
    for doc in {r["doc"] for r in source}:
        for m in plain([r for r in source if r["doc"] == doc]):
            want[doc, m["material"]] = (m["records"], m["name"], m["symbol"], m["formula"], m["source"], ";".join(f"{k}={v}" for k, v in sorted(m["data"].items())), ";".join(m["elements"]))
    got = {(r.doc, r.material): (r.records, r["name"], r.symbol, r.formula, r.source, r.data, r.elements) for r in collected_materials(spark, DATA).collect()}
    assert got == want and len(got) < len(source)
