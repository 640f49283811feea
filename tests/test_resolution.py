"""Resolution of samples, text mining, publishers and statistics against plain versions."""

import itertools
import json
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import measures, mining, records, resample, resolve
from marlstone.plans import screening
from marlstone.sources import documents, nested, publishers

M = ["sample_id", *resolve.MATERIAL_MATCH, "heating_rate_C_min", "SSA_m2_g"]
A = ["sample_id", *resolve.ADSORPTION_KEY, "Qmax"]


def _random_rows(fields, seed, papers=6, rows=14):
    rng = random.Random(seed)
    ids = [None, None, "BC", "BC-HCl", "MB-HNO3", "UNRESOLVED_x_001", "UNRESOLVED_x_002"]
    values = [None, None, "1", "2"]
    return [{"paper": f"p{p}", "ord": o, **{f: rng.choice(ids if f == "sample_id" else values) for f in fields}} for p in range(papers) for o in range(rows)]


def _frame(spark, rows, fields):
    return spark.createDataFrame([(r["paper"], r["ord"], *[r[f] for f in fields]) for r in rows], "paper string, ord long, " + ", ".join(f"{f} string" for f in fields))


def _same(got, want, fields):
    def key(r):
        return tuple(str(r[f]) for f in ("paper", "ord", *fields))

    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("seed", range(3))
def test_autofill_against_a_plain_version(spark, seed):
    drop = re.compile("^UNRESOLVED")
    materials = [r | {"sample_id": None if drop.match(r["sample_id"] or "") else r["sample_id"]} for r in _random_rows(M, seed)]
    adsorption = [r | {"sample_id": None if drop.match(r["sample_id"] or "") else r["sample_id"]} for r in _random_rows(A, seed + 50)]
    materials[0:14] = [r | {"sample_id": "only" if k == 3 else None} for k, r in enumerate(materials[0:14])]
    adsorption[0:14] = [r | {"sample_id": None} for r in adsorption[0:14]]
    got_m, got_a = resolve.autofill_ids(_frame(spark, materials, M), _frame(spark, adsorption, A))
    for paper in {r["paper"] for r in materials}:
        own = [[r for r in t if r["paper"] == paper] for t in (materials, adsorption)]
        every = {r["sample_id"] for t in own for r in t if r["sample_id"]}
        for t, fields in zip(own, (resolve.MATERIAL_KEY, resolve.ADSORPTION_KEY), strict=True):
            known = [r for r in t if r["sample_id"]]
            for r in t:
                if r["sample_id"]:
                    continue
                same = {k["sample_id"] for k in known if all(k[f] == r[f] for f in fields)} if any(r[f] for f in fields) else set()
                found = every if len(every) == 1 else same
                if len(found) != 1 and t is own[1]:
                    votes, best = Counter(), 0
                    for k in known:
                        score = sum(1 for f in fields if r[f] and r[f] == k[f])
                        votes[k["sample_id"]] += score
                        best = max(best, score)
                    top = [s for s, n in votes.items() if n == max(votes.values())]
                    found = set(top) if best >= 2 and len(top) == 1 else set()
                if len(found) == 1:
                    r["sample_id"] = next(iter(found))
                    known.append(r)
    _same([r.asDict() for r in got_m.collect()], materials, M)
    _same([r.asDict() for r in got_a.collect()], adsorption, A)


@pytest.mark.parametrize("seed", range(3))
def test_absorb_against_a_plain_version(spark, seed):
    rows = _random_rows(M, seed)
    got = resolve.absorb(_frame(spark, rows, M), resolve.MATERIAL_MATCH, M[1:], resolve.SHARED).collect()
    want = []
    for _, group in itertools.groupby(rows, key=lambda r: r["paper"]):
        group = [dict(r) for r in group]
        loose, sound = [r for r in group if (r["sample_id"] or "").startswith("UNRES")], [r for r in group if not (r["sample_id"] or "").startswith("UNRES")]
        left = []
        for r in loose:
            ranked = sorted(((sum(1 for f in resolve.MATERIAL_MATCH if r[f] and r[f] == s[f]), -k) for k, s in enumerate(sound)), reverse=True)
            took = False
            if ranked and ranked[0][0] >= 2 and (len(ranked) == 1 or ranked[1][0] < ranked[0][0]):
                target = sound[-ranked[0][1]]
                for f in M[1:]:
                    if target[f] is None and r[f] is not None:
                        target[f], took = r[f], True
            if not took:
                left.append(r)
        for f in resolve.SHARED:
            values = {r[f] for r in left if r[f]}
            if len(values) == 1:
                for s in sound:
                    s[f] = s[f] or next(iter(values))
        want += sound
    _same([r.asDict() for r in got], want, M)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_merge_against_a_plain_version(spark, seed):
    rows = [r | {"sample_id": None if (r["sample_id"] or "").startswith("UN") else r["sample_id"]} for r in _random_rows(A, seed, rows=20)]
    columns, cues = [*resolve.ADSORPTION_KEY, "Qmax"], resolve.CONDITIONS
    got = records.greedy_merge(_frame(spark, rows, A), "paper", ["sample_id"], columns, "ord", 1, cues).collect()
    want = []
    for _, group in itertools.groupby(rows, key=lambda r: r["paper"]):
        kept = []
        for r in group:
            for k in kept:
                if any(k[f] and r[f] and k[f] != r[f] for f in ("sample_id", *columns)):
                    continue
                if not (k["sample_id"] and r["sample_id"]) and not any(k[f] and k[f] == r[f] for f in cues):
                    continue
                k.update({f: k[f] or r[f] for f in ("sample_id", *columns)}, merged_rows=k["merged_rows"] + 1)
                break
            else:
                kept.append(r | {"merged_rows": 1})
        want += kept
    _same([r.asDict() for r in got], want, [*A, "merged_rows"])


def test_shared_fields_go_to_bases_and_from_them(spark):
    fields = ["sample_id", "acid_type", "acid_conc_mol_L", "acid_time_h", "acid_temp_C", "biomass_source", "pyrolysis_temp_C", "hold_duration_h", "heating_rate_C_min", "modification_sequence"]
    rows = [
        {"sample_id": "BC"}, {"sample_id": "BC-HCl", "acid_type": "HCl", "acid_conc_mol_L": "1"}, {"sample_id": "HCl_BC", "acid_type": "hcl"}, {"sample_id": "X1", "biomass_source": "straw"},
        {"sample_id": "BC", "pyrolysis_temp_C": "500", "acid_type": "HCl"}, {"sample_id": "MB-1", "hold_duration_h": "2"},
    ]
    df = _frame(spark, [{"paper": "p", "ord": k, **dict.fromkeys(fields), **r} for k, r in enumerate(rows)], fields)
    out = {r["ord"]: r for r in resolve.fill_shared_materials(df).collect()}
    assert [out[k]["acid_conc_mol_L"] for k in range(6)] == [None, "1", "1", None, "1", None]
    assert [out[k]["biomass_source"] for k in range(6)] == ["straw", None, None, "straw", "straw", None]
    assert [out[k]["pyrolysis_temp_C"] for k in range(6)] == ["500", "500", "500", None, "500", None]
    assert [out[k]["hold_duration_h"] for k in range(6)] == ["2", "2", "2", None, "2", "2"]
    cleared = {r["ord"]: r["acid_type"] for r in resolve.clear_base_acid(df).collect()}
    assert cleared == {0: None, 1: "HCl", 2: "hcl", 3: None, 4: None, 5: None}


def test_adsorption_rows_collapse_by_conditions(spark):
    rows = [
        ("a-main.pdf", "BC sample", "U(VI)", "5", None, "12"), ("a-mmc1.pdf", "bc", "u(vi)", "5", None, None), ("a-main.pdf", "BC", "U(VI)", "6", None, "7"), ("a-main.pdf", None, "U(VI)", "5", None, "1"), ("a-main.pdf", None, "U(VI)", "5", None, "1"),
    ]
    df = spark.createDataFrame([("p", k, f, s, p, ph, t, None, None, q) for k, (f, s, p, ph, t, q) in enumerate(rows)], "paper string, ord long, filename string, sample_id string, pollutant_name string, pH string, T_K string, Te_min string, SLR_g_L string, Qmax string")
    out = sorted((r["sample_id"] or "", r["pollutant_name"], r["pH"], r["Qmax"]) for r in resolve.collapse_adsorption(df).collect())
    assert out == [("", "U(VI)", "5", "1"), ("", "U(VI)", "5", "1"), ("BC", "U(VI)", "6", "7"), ("bc", "U(VI)", "5", "12")]


def test_backfill_from_text(spark):
    texts = spark.createDataFrame([("x/Foo.pdf", "Biochar was pyrolysed at 500 °C and held for 2 h, heating 10 °C/min. It was soaked in nitric acid (2 M) and the acid treated char kept 24 h; treated 24 h."), ("Bar.pdf", "hcl and nitric, nothing else")], "filename string, text string")
    fields = ["pyrolysis_temp_C", "hold_duration_h", "heating_rate_C_min", "acid_type", "acid_conc_mol_L", "acid_time_h", "modification_sequence"]
    rows = [("Foo.pdf", 1, None, None, "5", None, None, None, "acid wash"), ("foo.pdf", 2, "600", None, None, None, None, None, None), ("Bar.pdf", 3, None, None, None, None, None, None, "acid"), ("none.pdf", 4, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "filename string, ord long, " + ", ".join(f"{f} string" for f in fields))
    filled, fills = mining.backfill_from_text(df, texts)
    out = {r["ord"]: r for r in filled.collect()}
    assert (out[1]["pyrolysis_temp_C"], out[1]["heating_rate_C_min"], out[1]["acid_type"], out[1]["acid_conc_mol_L"], out[1]["acid_time_h"]) == ("500", "5", "HNO3", "2", "24")
    assert out[2]["pyrolysis_temp_C"] == "600" and out[2]["heating_rate_C_min"] == "10" and out[2]["acid_type"] is None
    assert all(out[3][f] is None and out[4][f] is None for f in fields[:-1])
    assert {(r["ord"], r["field"], r["value"]) for r in fills.collect()} >= {(1, "acid_type", "HNO3"), (2, "heating_rate_C_min", "10")}


def test_context_of_matches(spark):
    rng = random.Random(4)
    words = ["acid", "12 h", "7h", "xx", "treated", "3 h and", "modif", "0.5 h", "lorem ipsum dolor sit amet consectetur", "hh"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)] + ["", "acid"]
    p = mining.METHOD_PATTERNS[4]
    got = [r["m"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", mining.matches(F.col("t"), p).alias("m")).orderBy("k").collect()]
    want = [[m.group(1) for m in re.finditer(p.pattern, t) if any(w in t[max(0, m.start() - p.before) : m.end() + p.after] for w in p.near)] for t in texts]
    assert got == want


def test_texts_of_files(spark):
    elements = spark.createDataFrame([("d", "cln_elements", 1, "c1"), ("d", "elements", 2, "e2"), ("d", "elements", 1, "e1"), ("d", "elements", 3, " "), ("e", "elements", 1, "only")], "folder string, grp string, ord int, t string")
    files = spark.createDataFrame([("d", "A.pdf"), ("d", "B.pdf"), ("d", None)], "folder string, name string")
    out = {r["filename"]: r["text"] for r in mining.texts_of_files(elements, "folder", "grp", "ord", "t", files, "name").collect()}
    assert out == {"A.pdf": "e1\ne2\nc1", "B.pdf": "e1\ne2\nc1", "e.pdf": "only"}


def test_supplements_find_their_article(spark):
    names = {"one": ["Art.pdf", "Supplementary information.pdf", "notes.txt"], "two": ["Alpha 2020.pdf", "Beta.pdf", "alpha_2020_si.docx", "appendix.pdf", "Beta data.docx"]}
    out = mining.supplements_of(spark.createDataFrame([(f, n) for f, ns in names.items() for n in ns], "folder string, name string"), "folder", "name")
    assert {tuple(r) for r in out.collect()} == {("one", "Art.pdf", "Supplementary information.pdf"), ("two", "Alpha 2020.pdf", "alpha_2020_si.docx"), ("two", "Beta.pdf", "Beta data.docx")}


def test_text_functions(spark):
    cases = [
        (T.plain_filename(F.lit("主文-原始_Foo.pdf")), "Foo.pdf"), (T.dedupe_scalar(F.lit("12 1212")), "12"), (T.dedupe_scalar(F.lit("12 13")), "12 13"), (T.general_number(F.lit(0.00001234567)), "1.23457e-05"),
        (T.general_number(F.lit(1234567.0)), "1.23457e+06"), (T.general_number(F.lit(100.0)), "100"), (T.general_number(F.lit(0.05)), "0.05"), (T.general_number(F.lit(0.0)), "0"), (T.whole_or_short(F.lit(3.0)), "3"), (T.whole_or_short(F.lit(2.345)), "2.35"),
        (T.sample_aliases(F.lit("SDB350 modified with 96S")), ["sdb350modifiedwith96s", "sdb35096s"]), (T.plain_markup(F.lit('<table id="a" frame="b"><ce:italic>x</ce:italic><inf loc="post">2</inf><hsp sp="1">z</hsp></table>\n\n\ny')), "<table>x2</table>\ny"),
        (T.approximate_tokens(F.lit("abcde")), 2), (documents.leading_share(F.lit("x" * 5000), F.lit(10), 4), "x" * 2000), (documents.leading_share(F.lit("x" * 500), F.lit(3), 4), "x" * 500),
    ]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, w in cases]


def test_nested_and_flat_records(spark):
    data = {"a": {"Target-1": [{"x": 1}, "text", {"target": {"y": "z"}}]}, "target": {"k": None}, "b": [{"target_2": {"q": [1]}}]}
    out = nested.nested_rows(spark.createDataFrame([(1, json.dumps(data)), (2, "broken"), (3, None)], "id int, d string"), "id", "d", ["target"]).collect()
    assert Counter((r["id"], r["key"], json.dumps(r["row"], sort_keys=True)) for r in out) == Counter([
        (1, "Target-1", '{"x": "1"}'), (1, "Target-1", '{"target": "{\\"y\\":\\"z\\"}"}'), (1, "target", '{"y": "z"}'), (1, "target", '{"k": null}'), (1, "target_2", '{"q": "[1]"}'),
    ])
    assert documents.flat_records([[{"a": 1}, "x"], [[{"b": 2}]]]) == [{"a": 1}, {"b": 2}]
    with pytest.raises(TypeError):
        documents.flat_records([3])


def test_files_and_pages(spark, tmp_path):
    for n in ("b.pdf", "a.pdf", "a supplementary.pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"1|2|3")
    found = documents.find_files(spark, str(tmp_path), mains_only=True)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.pdf", "b.pdf"]
    assert documents.find_files(spark, str(tmp_path), most=1).count() == 1
    with pytest.raises(ValueError):
        documents.find_files(spark, str(tmp_path / "c.txt"))

    def parser(content, most):
        if most > 5:
            raise RuntimeError("no")
        pages = content.decode().split("|")
        return pages[:most], len(pages)

    assert [(r["text"], r["pages"], r["error"]) for r in documents.extract_texts(found, parser, 2).collect()] == [("1\n2", 3, None)] * 2
    assert all(r["error"] == "RuntimeError: no" for r in documents.extract_texts(found, parser, 9).collect())


_JATS = (
    '<article><front><journal-title>J</journal-title><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>A title</article-title></title-group>'
    '<publisher-name>P</publisher-name><contrib contrib-type="author"><name>Ann Lee</name></contrib><contrib><name>Bo</name></contrib><pub-date pub-type="epub"><month>3</month><year>2021</year></pub-date></front>'
    "<body><title>Short</title><p>Long text <xref>[1]</xref> of the article.</p><table-wrap><p>cell</p></table-wrap><caption><p>no</p></caption><fig>F 1</fig></body></article>"
)


def test_publisher_dialects(spark):
    df = spark.createDataFrame([(1, _JATS)], "id int, m string")
    acs = [(r["type"], r["content"]) for r in publishers.articles(df, "id", "m", "acs").collect()]
    assert acs[0] == ("text", "Short\n\nLong text of the article.") and ("table", "cell") in acs and ("figure", "F 1") in acs and not any("no" == c for _, c in acs)
    mdpi = [(r["type"], r["content"]) for r in publishers.articles(df, "id", "m", "mdpi").collect()]
    assert mdpi[:2] == [("text", "Short"), ("text", "Long text of the article.")]
    springer = [(r["type"], r["content"]) for r in publishers.articles(df, "id", "m", "springer").collect()]
    assert springer[0] == ("text", "Short\n\nLong text [1] of the article.")
    meta = publishers.metadata(df, "id", "m", "mdpi").first()
    assert (meta["doi"], meta["title"], meta["journal"], meta["date"], meta["authors"]) == ("10.1/x", "A title", "J", "2021.03", ["Ann Lee"])
    meta = publishers.metadata(df, "id", "m", "springer").first()
    assert (meta["title"], meta["journal"], meta["date"], meta["authors"]) == ("A title", "P", "2021.03", ["Ann Lee", "Bo"])
    core = "<doc><dc:identifier>doi:10.1/y</dc:identifier><dc:title> T </dc:title><prism:coverDate>2020-05-06</prism:coverDate><dc:creator>C</dc:creator><ce:para>One <ce:cross-ref>[2]</ce:cross-ref>two.</ce:para><ce:caption><ce:para>no</ce:para></ce:caption></doc>"
    df = spark.createDataFrame([(1, core)], "id int, m string")
    meta = publishers.metadata(df, "id", "m", "elsevier").first()
    assert (meta["doi"], meta["title"], meta["journal"], meta["date"], meta["authors"]) == ("10.1/y", "T", "", "2020.05", ["C"])
    assert [(r["type"], r["content"]) for r in publishers.articles(df, "id", "m", "elsevier").collect()] == [("text", "One two.")]
    page = '<meta name="citation_doi" content="10.1/z"><meta name="citation_title" content="T"><meta name="citation_author" content="A"><p>Text <a href="#">1</a> here.</p><p id="fig1">no</p><table class="t"><tr><td>1</td></tr></table><div class="image_table">fig</div><table><td>2</td></table>'
    df = spark.createDataFrame([(1, page), (2, None)], "id int, m string")
    assert [(r["type"], r["content"]) for r in publishers.articles(df.where("id = 1"), "id", "m", "rsc").collect()] == [("text", "Text here."), ("table", "1"), ("figure", "fig")]
    assert {r["id"]: r["error"] for r in publishers.metadata(df, "id", "m", "rsc").collect()} == {1: "metadata without journal, date", 2: "metadata without doi, title, journal, date"}
    assert publishers.articles(df.where("id = 2"), "id", "m", "rsc").first()["type"] == "error"
    with pytest.raises(ValueError):
        publishers.articles(df, "id", "m", "unknown")


def test_every_rule_of_the_screening_is_reached(spark):
    rng = random.Random(9)
    names = ["n_review", "n_method", "n_topic", "n_biochar_prep", "n_biochar_word", "n_radionuclide", "n_acid_reagent", "n_acid_mod", "n_heavy_metal", "n_acid_context", "acid_prep_sentences", "recipe_windows", "acid_conditions", "ph_sentences", "n_characterization", "n_ads_condition", "n_ads_performance", "data_score", "unit_hits"]
    rows = []
    for _ in range(6000):
        full = rng.random() < 0.8
        rows.append((rng.random() < 0.05, *[rng.choice([0, 1, 1, 2, 3, 4, 8]) if rng.random() < 0.15 or not full else rng.choice([1, 2, 3, 4]) if n not in ("n_review", "ph_sentences") else 0 for n in names]))
    # pH adjustment alone, and texts without data, are rare by chance
    usual = dict.fromkeys(names, 1) | {"n_review": 0, "ph_sentences": 0}
    rows += [(False, *(usual | {"ph_sentences": 1, "n_acid_context": 0}).values()), (False, *(usual | {"data_score": 0, "unit_hits": 0}).values()), (False, *(usual | {"n_method": 0, "data_score": 2}).values())]
    df = spark.createDataFrame(rows, "scanned_suspect boolean, " + ", ".join(f"{n} int" for n in names))
    out = screening.verdicts(df).select("profile", "scanned_suspect", *names, "status", "reason").collect()
    seen = set()
    for r in out:
        d, strict, nuclide, loose = r.asDict(), r["profile"] != "legacy", "radionuclide" in r["profile"], r["profile"].endswith("loose")
        data, units = d["data_score"], d["unit_hits"]
        rich = d["n_method"] >= 1 and (data >= 3 or units >= 6)
        checks = [d["scanned_suspect"], strict and d["n_review"] > 0 and d["n_method"] <= 2, strict and 0 in (d["n_topic"], d["n_biochar_prep"]), nuclide and not d["n_biochar_word"], nuclide and not d["n_radionuclide"],
            loose and not d["n_acid_reagent"] and d["n_acid_mod"] > 0, strict and not d["n_acid_reagent"], strict and not d["n_heavy_metal"], loose and not d["acid_prep_sentences"] and d["n_acid_mod"] + d["n_acid_context"] > 0,
            strict and not d["acid_prep_sentences"], loose and not d["recipe_windows"], strict and not d["recipe_windows"], loose and not d["acid_conditions"], strict and not d["acid_conditions"],
            strict and d["ph_sentences"] > 0 and d["acid_prep_sentences"] <= 1 and not d["n_acid_context"], strict and not d["n_characterization"], strict and not d["n_ads_condition"], strict and not d["n_ads_performance"],
            nuclide and not loose and rich, loose and rich, strict and rich, nuclide and (data >= 2 or units >= 4), strict and (data >= 2 or units >= 4), nuclide, strict,
            d["n_topic"] >= 3 and d["n_method"] >= 1 and (data >= 4 or units >= 8), d["n_topic"] >= 2 and (data >= 2 or units >= 4), True]
        k = checks.index(True)
        seen.add(k)
        assert (r["status"], r["reason"]) == screening.RULES[k][1:]
    assert seen == set(range(28))


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = 300
    x, g, c = rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 20, n)
    y = 0.3 * x + np.array([0, 0.5, -0.4])[g] + rng.normal(size=n) * 0.2 + 1
    df = spark.createDataFrame([(float(a), "ABC"[b], int(k), float(v)) for a, b, k, v in zip(x, g, c, y, strict=True)], "x double, g string, c int, y double")

    def terms(flag):
        return {"x": F.col("x"), **dict(zip(("B", "C"), measures.one_hot(flag, list("ABC")), strict=True))}

    fit = measures.least_squares(df, terms(F.col("g")), "y")
    d = np.column_stack([np.ones(n), x, g == 1, g == 2]).astype(float)
    inverse = np.linalg.inv(d.T @ d)
    beta = inverse @ d.T @ y
    e = (y - d @ beta) / (1 - np.sum((d @ inverse) * d, axis=1))
    cov = inverse @ (d.T @ (e[:, None] ** 2 * d)) @ inverse
    for row, level in zip(measures.standardized_means(df, fit, {k: terms(F.lit(k)) for k in "ABC"}), range(3), strict=True):
        at = np.array([1, x.mean(), level == 1, level == 2], float)
        link, se = at @ beta, np.sqrt(at @ cov @ at)
        assert np.allclose([row["estimate"], row["low"], row["high"]], np.exp([link, link - 1.96 * se, link + 1.96 * se]))
    blocks = {"x": {"x": F.col("x")}, "g": dict(zip(("B", "C"), measures.one_hot(F.col("g"), list("ABC")), strict=True))}
    sse = {k: np.linalg.lstsq(d[:, list(k)], y, rcond=None)[1][0] for k in ((0, 1, 2, 3), (0, 2, 3), (0, 1))}
    out = {r["block"]: r for r in measures.block_contributions(df, blocks, "y")}
    sst = ((y - y.mean()) ** 2).sum()
    for name, k in (("x", (0, 2, 3)), ("g", (0, 1))):
        lost = sse[k] - sse[0, 1, 2, 3]
        assert np.allclose([out[name]["delta_r2"], out[name]["partial_r2"]], [lost / sst, lost / sse[k]])
    assert np.isclose(sum(r["relative_pct"] for r in out.values()), 100) and measures.block_contributions(df.limit(5), blocks, "y") == []
    low, high = measures.parametric_bootstrap(fit, [0, 1, 0, 0], 4000)
    spread = np.sqrt(fit.sse / fit.residual_df * inverse[1, 1])
    assert np.allclose([low, high], [beta[1] - 1.96 * spread, beta[1] + 1.96 * spread], atol=0.15 * spread)
    got = {r["term"]: r for r in resample.refit_bootstrap(df, "c", terms(F.col("g")), "y", 50).collect()}
    weights = np.zeros((20, 50))
    for r in spark.range(20).select(F.col("id").cast("int").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("r")).withColumn("w", resample.poisson_weight(F.col("u"), F.col("r"), 1009)).collect():
        weights[r["u"], r["r"]] = r["w"]
    betas = np.array([np.linalg.solve(d.T @ (w[c][:, None] * d), d.T @ (w[c] * y)) for w in weights.T])
    for k, term in enumerate(("intercept", "x", "B", "C")):
        assert np.allclose([got[term]["estimate"], got[term]["low"], got[term]["high"]], [beta[k], *np.percentile(betas[:, k], [2.5, 97.5])]) and got[term]["replicas"] == 50


def test_required_columns(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert records.missing_columns(df, ["b", "c", "a", "d"]) == ["c", "d"] and records.require_columns(df, ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        records.require_columns(df, ["c"])


def _merged_plainly(rows, fields, least, block, cues):
    kept = []
    for row in rows:
        for k in kept:
            known = [c for c in block if k[c] is not None and row[c] is not None]
            both = [c for c in fields if k[c] is not None and row[c] is not None]
            if all(k[c] == row[c] for c in both) and (len(known) == len(block) or sum(c in cues for c in both if c not in block) >= least):
                k.update({c: row[c] for c in fields if k[c] is None}, merged_rows=k["merged_rows"] + 1)
                break
        else:
            kept.append(row | {"merged_rows": 1})
    return kept


@pytest.mark.parametrize("seed", range(30))
def test_kept_rows_are_looked_up_as_by_comparing_all(seed):
    rng = random.Random(seed)
    fields = ["s", "a", "b", "c"]
    rows = [{c: rng.choice([None, None, "1", "2", "3"]) for c in fields} for _ in range(120)]
    kept = records._Kept(["s"], ["a", "b", "c"], frozenset("ab"), 1)
    for row in rows:
        hit = kept.first(row)
        if hit is None:
            kept.add(row | {"merged_rows": 1})
        else:
            kept.fill(hit, row)
            kept.rows[hit]["merged_rows"] += 1
    assert kept.rows == _merged_plainly(rows, fields, 1, ["s"], "ab")


def test_a_large_paper_is_merged_in_linear_time():
    began = time.process_time()
    kept = records._Kept(["s"], ["a", "b"], frozenset("ab"), 1)
    for k in range(20_000):
        row = {"s": "x", "a": str(k), "b": None}
        assert kept.first(row) is None
        kept.add(row)
    assert time.process_time() - began < 10


@pytest.mark.parametrize("seed", range(10))
def test_votes_counted_by_id_equal_votes_of_all_rows(seed):
    rng = random.Random(seed)
    evidence, rows = resolve.Evidence(["a", "b", "c"]), []
    for _ in range(60):
        row = {"sample_id": rng.choice("xyz"), **{f: rng.choice([None, "1", "2", "3"]) for f in "abc"}}
        rows.append(row)
        evidence.add(row)
        asked = {f: rng.choice([None, "1", "2", "4"]) for f in "abc"}
        scores = [(sum(asked[f] is not None and asked[f] == r[f] for f in "abc"), r["sample_id"]) for r in rows]
        votes = sorted(((sum(s for s, i in scores if i == n), n) for n in "xyz"), reverse=True)
        want = votes[0][1] if max(scores)[0] >= 2 and votes[0][0] > votes[1][0] else None
        assert evidence.by_vote(asked) == want


def test_matches_with_context_cost_one_reading_of_the_text(spark):
    text = "".join(f"the {k} a, " for k in range(6000))
    df = spark.createDataFrame([(1, text)], "i int, t string")
    began = time.monotonic()
    found = df.select(mining.matches(F.col("t"), mining.Pattern("n", r"(\d+)\s*[a-z]", 1, 1e6, ("the",), 40, 30)).alias("n")).first()["n"]
    assert found == [str(k) for k in range(6000)] and time.monotonic() - began < 15


def test_sentences_do_not_search_the_whole_text_again(spark):
    text = "Wash it. " * 20_000 + "Biochar was treated with hcl at 2 M. "
    df = spark.createDataFrame([(1, text)], "i int, text string")
    began = time.monotonic()
    row = screening.signals(df).select("acid_conditions", "ph_sentences").first()
    assert row["acid_conditions"] == 1 and row["ph_sentences"] == 0 and time.monotonic() - began < 25
