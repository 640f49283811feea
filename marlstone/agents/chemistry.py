"""Names and formulas of materials. Records of one material are brought together by ``operators.collect``."""

from __future__ import annotations

import re

#: Symbols of the elements, by rows of the periodic table.
ELEMENTS = frozenset(
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn "
    "Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og X".split()
)
#: What no usual formula holds; words that number a compound.
UNUSUAL = ("‘", "0-D", "+", ",", "∝")
_COMPOUND = "[Mm]OF|[Cc]omplex|[Cc]ompound|[Ss]tructure"
_SUBSCRIPTS = str.maketrans("₀₁₂₃₄₅₆₇₈₉", "0123456789")
_WATER = re.compile(r"([^\s·]+)\s*·\s*(?:\d*|n)H2O.*")


def _plain(text: str) -> str:
    return re.sub(r"<[^>]+>", "", text).translate(_SUBSCRIPTS)


def chemical_name(text: str | None) -> str | None:
    """A name without markup, subscripts and water of crystallisation; of ``Complex 3`` and the like the number."""
    if not text:
        return None
    name = _plain(text.replace("⋅", "·"))
    name = re.sub(rf"(?:{_COMPOUND})\s*(\d+)", r"\1", name)
    name = re.sub(rf"(\d+)\s*(?:{_COMPOUND})", r"\1", name)
    head, brace, tail = name.rpartition("}")
    if not brace:
        return _WATER.sub(r"\1", name)
    # a formula in braces is kept whole; what follows it may begin with the dot
    return head + brace + _WATER.sub(r"\1", "a" + tail)[1:]


def chemical_formula(text: str | None) -> tuple[str | None, bool | None]:
    """Elements with their counts in alphabetical order, and whether the formula is of the usual kind; one that is not stays as it is."""
    if not text:
        return None, None
    if text.lower() == "unknown":
        return "", False
    bare = re.sub(r"\s*⋅\d+\w+", "", _plain(text).replace("(", "").replace(")", ""))
    parts = re.findall(r"([A-Z][a-z]?)(\d*\.?\d*)", bare)
    if any(u in text for u in UNUSUAL) or "[" in bare or "]" in bare or not parts or any(e not in ELEMENTS for e, _ in parts):
        return text, False
    return " ".join(sorted(f"{e}{n or '1'}" for e, n in parts)), True
