"""Records from Markdown tables: material properties and adsorption conditions.

The parser is a table function: one text in, any number of records out. It runs over
Arrow batches; header words are matched by patterns, specific fields before general
ones, and tables that list properties by row are read the other way round.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# ---- fixed values: output columns and header patterns ----
MATERIAL_FIELDS = [
    "sample_id", "biomass_source", "pyrolysis_temp_C", "hold_duration_h", "heating_rate_C_min", "acid_type", "acid_conc_mol_L", "acid_time_h", "acid_temp_C",
    "modification_sequence", "SSA_m2_g", "APS_nm", "TPV_cm3_g", "ash_percent", "C_percent", "O_percent", "N_percent", "H_percent", "pH_pzc",
]
ADSORPTION_FIELDS = ["sample_id", "pollutant_name", "pH", "T_K", "Te_min", "SLR_g_L", "Qmax"]
MATERIAL_HEADERS = {
    "pyrolysis_temp_C": r"\b(?:pyrolysis|carbonization|htc|hydrothermal)\b.*\btemp",
    "acid_time_h": r"\b(?:acid|treatment|activation|impregnation)\b.*\btime\b",
    "acid_temp_C": r"\b(?:acid|treatment|activation)\b.*\btemp\b",
    "acid_conc_mol_L": r"\bconc|\bmolar|\bmol/?l\b|\bwt%?\b|\bw/w\b|\bv/v\b",
    "heating_rate_C_min": r"\bheating rate\b|\bramp\b",
    "hold_duration_h": r"\bhold\b|\bresidence\b|\bretention\b|\bduration\b|\btime at\b",
    "SSA_m2_g": r"\bssa\b|\bs[\s_-]*bet\b|\bbet\b|\bsurface area\b|\bm2/g\b",
    "APS_nm": r"\baps\b|\baverage pore size\b|\bpore diameter\b|\bnm\b",
    "TPV_cm3_g": r"\btpv\b|\bpore volume\b|\bcm3/g\b",
    "ash_percent": r"\bash\b",
    "C_percent": r"(?:^|[^a-z])c\s*\(%?\)|\bc%$|\bc percent\b|\bcarbon\b",
    "O_percent": r"(?:^|[^a-z])o\s*\(%?\)|\bo%$|\bo percent\b|\boxygen\b",
    "N_percent": r"(?:^|[^a-z])n\s*\(%?\)|\bn%$|\bn percent\b|\bnitrogen\b",
    "H_percent": r"(?:^|[^a-z])h\s*\(%?\)|\bh%$|\bh percent\b|\bhydrogen\b",
    "pH_pzc": r"\bp[hz]?[_\s-]*(?:pzc|zpc)\b|\b(?:pzc|zpc)\b|^ph$",
    "acid_type": r"\bacid\b|\bactivator\b|\bmodifier\b|\bmodification agent\b",
    "modification_sequence": r"\bmethod\b|\bprocedure\b|\bsequence\b|\broute\b|\bmodification\b",
    "biomass_source": r"\bbiomass\b|\bfeedstock\b|\bprecursor\b|\bsource\b|\braw material\b",
    "sample_id": r"\bsample\b|\badsorbent\b|\bmaterial\b|\bbiochar\b|\bcode\b|\bid\b",
}
ADSORPTION_HEADERS = {
    "Qmax": r"\bq\s*max\b|\bqm\b|\b(?:maximum|monolayer|langmuir)\s+(?:adsorption\s+)?capacity\b",
    "SLR_g_L": r"\bslr\b|\bsolid\s*liquid\s*ratio\b|\bsolid/liquid\b|\badsorbent\s*dose\b|\bdosage\b|\bg/?l\b",
    "pH": r"^ph\b|\b(?:solution|initial)\s*ph\b",
    "Te_min": r"\b(?:equilibrium|contact)?\s*time\b|\bte\b|\bmin\b|\bhour|\bhr\b",
    "T_K": r"\btemperature\b|\btemp\b|^t$|\bt\s*\(?k\)?(?:\b|$)|^k$",
    "pollutant_name": r"\bpollutant\b|\badsorbate\b|\bmetal\b|\bion\b|\bcontaminant\b|\bsolute\b",
    "sample_id": r"\bsample\b|\badsorbent\b|\bsorbent\b|\bmaterial\b|\bbiochar\b|\bcode\b|\bid\b",
}
ADSORPTION_HINT = r"adsorption|isotherm|kinetic|adsorbent|adsorbate|pollutant|metal|ion|qe|qmax|langmuir|freundlich"
_UNIT = re.compile(r"\(?\s*(?:mg/?l|mg/?g|g/?l|mol/?l|m2/?g|cm3/?g|nm|k|°c|º?c|min|h|hr|hours?|wt%|%|-)\s*\)?")


def _clean(cell: str) -> str:
    return " ".join(re.sub(r"<[^>]+>|\[\^[^\]]+\]", " ", cell).split())


def _plain(text: str) -> str:
    text = re.sub(r"<[^>]+>|\[[^\]]+\]", " ", text.lower()).replace("_", " ")
    return " ".join(re.sub(r"[^a-z0-9%()+./ -]+", " ", text).split())


def grid(markdown: str | None) -> list[list[str]]:
    """Cells of the lines with a pipe, as wide as the widest, separator lines left out."""
    rows = []
    for line in (markdown or "").splitlines():
        cells = [_clean(c) for c in re.sub(r"^\||\|$", "", line.strip()).split("|")] if "|" in line else []
        if len(cells) >= 2 and sum(bool(re.fullmatch(r":?-{2,}:?", c)) for c in cells) < max(1, math.ceil(0.6 * len(cells))):
            rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def field_of(header: str, patterns: dict[str, str]) -> str | None:
    text = _plain(header)
    return next((f for f, p in patterns.items() if re.search(p, text)), None) if text else None


def like_sample(cell: str) -> bool:
    """Short, with a letter, no plain word and no caption."""
    return bool(cell) and len(cell) <= 40 and bool(re.search("[A-Za-z]", cell)) and not re.fullmatch("[A-Z][a-z]{5,}", cell) and not re.search("table|figure|reference|content", cell, re.I)


def _headed(rows: list[list[str]], patterns: dict[str, str]) -> tuple[list[str], list[list[str]]]:
    """Header and body; up to two rows of units or sub-headers are joined to the header."""
    head, body = rows[0], rows[1:]
    for _ in range(2):
        if not body:
            break
        units = sum(not c or bool(_UNIT.fullmatch(c.lower())) for c in body[0])
        if units < math.ceil(0.6 * len(head)) or not any(body[0]):
            break
        head = [a if not b or a.lower() == b.lower() else f"{a} {b}".strip() for a, b in zip(head, body[0], strict=True)]
        body = body[1:]
    return head, body


def _columns(head: list[str], patterns: dict[str, str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, h in enumerate(head):
        f = field_of(h, patterns)
        if f:
            out.setdefault(f, i)
    return out


def _sample_column(body: list[list[str]], found: dict[str, int], probe: int = 20) -> int | None:
    if "sample_id" in found:
        return found["sample_id"]
    scores = [sum(like_sample(r[i]) for r in body[:probe]) for i in range(len(body[0]))]
    return scores.index(max(scores)) if max(scores, default=0) > 0 else None


def _once(cell: str) -> str:
    parts = cell.split()
    return parts[0] if parts and len(set(parts)) == 1 else cell


def _distinct(records: list[dict]) -> list[dict]:
    return list({tuple(r.items()): r for r in reversed(records)}.values())[::-1]


def material_records(markdown: str | None) -> list[dict]:
    """Material rows of a table; blank cells and dashes are None. Micro- and mesopore volumes add up where no total is given."""
    rows = grid(markdown)
    if len(rows) < 2:
        return []
    head, body = _headed(rows, MATERIAL_HEADERS)
    if not body:
        return []
    labels = [[field_of(r[i], MATERIAL_HEADERS) for r in body[:30]] for i in range(len(head))]
    hits = [sum(x not in (None, "sample_id") for x in column) for column in labels]
    turned = hits.index(max(hits))
    samples = [i for i, h in enumerate(head) if i != turned and like_sample(h) and not _UNIT.fullmatch(h.lower()) and field_of(h, MATERIAL_HEADERS) is None]
    out = []
    if hits[turned] >= 2 and len(samples) >= 2:
        for i in samples:
            record = dict.fromkeys(MATERIAL_FIELDS) | {"sample_id": _once(head[i])}
            for r in body:
                f = field_of(r[turned], MATERIAL_HEADERS)
                if f not in (None, "sample_id") and r[i] not in ("", "-"):
                    record[f] = _once(r[i])
            out.append(record)
    else:
        found = _columns(head, MATERIAL_HEADERS)
        at = _sample_column(body, found)
        if at is None:
            return []
        pores = [i for i, h in enumerate(head) if re.search(r"\b(?:micro|meso)", _plain(h)) and "volume" in _plain(h)]
        for r in body:
            record = dict.fromkeys(MATERIAL_FIELDS) | {f: _once(r[i]) for f, i in found.items() if r[i] not in ("", "-")} | {"sample_id": _once(r[at])}
            if like_sample(record["sample_id"]):
                if record["TPV_cm3_g"] is None and len(pores) == 2 and all(re.fullmatch(r"[0-9.]+", r[i]) for i in pores):
                    record["TPV_cm3_g"] = f"{sum(float(r[i]) for i in pores):.4f}".rstrip("0").rstrip(".")
                out.append(record)
    return _distinct([r for r in out if any(v for k, v in r.items() if k != "sample_id")])


def _condition(field: str, cell: str, header: str) -> str | None:
    number = re.search(r"[-+]?[0-9]+(?:\.[0-9]+)?", cell.replace(",", ""))
    if not number:
        return None
    text, head, own = number.group(0), _plain(header), _plain(cell)
    if field == "T_K" and re.search(r"\bc\b|celsius", head) and not re.search(r"\bk\b", head):
        return f"{float(text) + 273.15:.4f}".rstrip("0").rstrip(".")
    hours = any(re.search(r"\b(?:hours?|hrs?|h)\b", x) and not re.search(r"\bmin\b", x) for x in (head, own))
    if field == "Te_min" and hours:
        return f"{float(text) * 60:.4f}".rstrip("0").rstrip(".")
    return text


def adsorption_records(markdown: str | None) -> list[dict]:
    """Adsorption rows of a table that has a condition column and speaks of adsorption; sample and pollutant carry down."""
    rows = grid(markdown)
    if len(rows) < 2:
        return []
    head, body = _headed(rows, ADSORPTION_HEADERS)
    found = _columns(head, ADSORPTION_HEADERS)
    conditions = [f for f in ("pH", "T_K", "Te_min", "SLR_g_L") if f in found]
    if not body or not conditions or not re.search(ADSORPTION_HINT, " ".join(map(_plain, head))):
        return []
    at = _sample_column(body, found)
    if at is None:
        return []
    out, sample, pollutant = [], "", ""
    for r in body:
        sample = r[at] or sample
        if "pollutant_name" in found:
            pollutant = r[found["pollutant_name"]] or pollutant
        record = dict.fromkeys(ADSORPTION_FIELDS) | {"sample_id": sample, "pollutant_name": pollutant or None}
        record |= {f: _condition(f, r[found[f]], head[found[f]]) for f in (*conditions, "Qmax") if f in found}
        if like_sample(sample) and any(v for k, v in record.items() if k != "sample_id"):
            out.append(record)
    return _distinct(out)


def _explode(records: Callable[[str | None], list[dict]], fields: list[str], ident: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, *r.values()) for i, text in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True) for n, r in enumerate(records(text))]
            yield pd.DataFrame(rows, columns=[ident, "ord", *fields]).astype({"ord": "int64"})

    return run


def extract(df: DataFrame, ident: str, text_col: str, kind: str = "material") -> DataFrame:
    """A row for each record of each text: ``ident, ord`` and the fields of the kind (``material`` or ``adsorption``)."""
    records, fields = (material_records, MATERIAL_FIELDS) if kind == "material" else (adsorption_records, ADSORPTION_FIELDS)
    schema = f"`{ident}` {dict(df.dtypes)[ident]}, ord long, " + ", ".join(f"`{f}` string" for f in fields)
    return df.select(ident, text_col).mapInPandas(_explode(records, fields, ident), schema)
