"""Text, key and number normalisers. Every function maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as missing beside blank text.
MISSING_WORDS = ["none", "nan", "na", "n/a", "null", "not_reported"]


def strip(c: Column) -> Column:
    """Leading and trailing white space off (Spark's own trim takes blanks only)."""
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Collapsed, lower-cased text; null counts as empty."""
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def is_blank(c: Column) -> Column:
    """Null or white space only."""
    return fold(c) == ""


def is_missing(c: Column) -> Column:
    """Blank, or a word for missing."""
    return is_blank(c) | fold(c).isin(MISSING_WORDS)


def is_void(c: Column) -> Column:
    """Null, NaN or white space only, for a column of any type."""
    return c.isNull() | (F.trim(c.cast("string")).isin("", "NaN"))


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def squeeze_lines(c: Column) -> Column:
    """NUL to blank, runs of blanks and tabs to one, three or more newlines to two, stripped."""
    t = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u0000"), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def _folding() -> tuple[str, str]:
    """Typographic variants by the plain character they become; zero-width characters, listed last, go."""
    def chars(*codes: int | tuple[int, int]) -> str:
        return "".join(chr(c) if isinstance(c, int) else "".join(map(chr, range(c[0], c[1] + 1))) for c in codes)

    classes = [
        (" ", chars(0xA0, 0x1680, (0x2000, 0x200A), 0x202F, 0x205F, 0x3000)),
        ("-", chars((0x2010, 0x2015), 0x2212, 0xFE58, 0xFE63, 0xFF0D)),
        ("~", chars(0x223C, 0x2DC, 0xFF5E)),
        ("'", chars((0x2018, 0x201B), 0x2032)),
        ('"', chars((0x201C, 0x201F), 0x2033)),
        ("/", chars(0x2044, 0x2215, 0xFF0F)),
        (",", chars(0x60C, 0x3001, 0xFF0C)),
        ("·", chars(0x2022, 0x2219, 0x22C5, 0x30FB)),
    ]
    gone = chars((0x200B, 0x200D), 0x2060, 0xFEFF)
    return "".join(c for _, c in classes) + gone, "".join(to * len(c) for to, c in classes)


def fold_unicode(c: Column) -> Column:
    """Typographic variants to plain characters: spaces, dashes, tildes, quotes, slashes, commas, middle dots; zero-width characters go. One pass."""
    return F.translate(c, *_folding())


def strip_tail(c: Column, markers: Sequence[str] = ("references", "reference"), share: float = 0.4) -> Column:
    """Text up to the first marker word, where that lies beyond ``share`` of the text; markers are tried in order."""
    low = F.lower(c)
    out = c
    for word in reversed(markers):
        at = F.regexp_instr(low, F.lit(rf"\b{word}\b"))
        out = F.when((at > 0) & ((at - 1) > F.length(c) * share), F.substring(c, F.lit(1), at - 1)).otherwise(out)
    return out


def sentences(c: Column) -> Column:
    """Array of sentences: cut at white space after ``.!?`` and at newlines, stripped, none empty."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """The words, in their order, that occur anywhere in the (lower-case) text."""
    pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(w.lower()).alias("k")) for w in words])
    # the text is bound first: inside the filter it would be computed for each word
    found = F.transform(F.array(text), lambda t: F.transform(F.filter(pairs, lambda p: F.contains(t, p.k)), lambda p: p.w))
    return F.get(found, F.lit(0))


def pattern_hits(text: Column, labelled: Sequence[tuple[str, str]]) -> Column:
    """Labels, in their order, whose pattern is found in the text, whatever the case."""
    found = [F.when(text.rlike(f"(?i){p}"), F.lit(label)) for label, p in labelled]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def canonical_key(c: Column) -> Column:
    """Lower case, blanks and hyphens to underscores."""
    return F.regexp_replace(F.lower(strip(c)), r"[\s-]+", "_")


def key_matches(c: Column, target: str) -> Column:
    """The target key itself, or it and a number."""
    return canonical_key(c).rlike(rf"^{target}(_[0-9]+)?$")


def alnum_key(c: Column) -> Column:
    """a-z and 0-9 of the lower-cased text."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def sample_key(c: Column) -> Column:
    """Upper case with A-Z, 0-9, ``-`` and ``.`` alone."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z0-9.\-]+", "")


def safe_stem(c: Column) -> Column:
    """A stem for file names: runs of other characters than A-Z, a-z, 0-9, ``.``, ``_`` and ``-`` as one underscore, these marks off either end, ``file`` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.when(kept == "", "file").otherwise(kept)


def clean_name(c: Column, most: int = 180) -> Column:
    """A file name without what file systems forbid (as underscores), white space as single blanks, cut after ``most`` characters."""
    kept = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r'[\\/:*?"<>|]+', "_")
    return F.substring(strip(F.regexp_replace(kept, r"(?U)\s+", " ")), 1, most)


def tokens(c: Column) -> Column:
    """Distinct alphanumeric tokens of the lower-cased text, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


#: What ends the stem of a supplement's file name.
_SUPPLEMENT = r"main|supplement(?:ary)?|supporting|suppinfo|appendix|si|mmc[0-9]+|sm[0-9]+|moesm[0-9]+|esm[0-9]+"


def _stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^.*[/\\]", ""), r"\.[^.]*$", "")


def paper_key(filename: Column) -> Column:
    """One key for an article and its supplements: stem, lower case, separators to blanks, supplement words off the end."""
    words = F.regexp_replace(F.lower(_stem(filename)), r"[\s._-]+", " ")
    return F.trim(F.regexp_replace(F.trim(words), rf"(?:(?:^| )(?:{_SUPPLEMENT}))+$", ""))


def is_supplement(filename: Column) -> Column:
    """A supplement word as a token of the name, a number after it allowed."""
    return F.regexp_replace(F.lower(_stem(filename)), r"[^a-z0-9]+", " ").rlike(rf"(?:^| )(?:supp(?:lement(?:ary)?|orting|info|l)?|appendix|si|esi|{_SUPPLEMENT.split('|', 1)[1]})[0-9]*(?: |$)")


def dedupe_scalar(c: Column) -> Column:
    """``x x x`` to ``x`` where all tokens are equal, and a number to itself where it alone is repeated, blanks between or not."""
    parts = F.split(collapse(c), " ")
    number = F.regexp_extract(collapse(c), r"^([0-9]+(?:\.[0-9]+)?)\s+(?:\1\s*)+$", 1)
    return F.when(F.size(F.array_distinct(parts)) == 1, parts[0]).when(number != "", number).otherwise(collapse(c))


def first_number(c: Column) -> Column:
    """The first signed decimal number of the text, commas taken out; null where there is none."""
    found = F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("")), r"[-+]?[0-9]+(?:\.[0-9]+)?", 0)
    return F.when(found != "", found)


def to_double(c: Column) -> Column:
    """A number, or null where the text is none."""
    return c.try_cast("double")


def short_number(x: Column, places: int = 4) -> Column:
    """Fixed decimals without trailing zeros."""
    text = F.format_string(f"%.{places}f", x)
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def to_kelvin(c: Column) -> Column:
    """A temperature text in kelvin: a stated K keeps its number, a stated °C gains 273.15, all else stays as it is."""
    t = F.lower(collapse(c))
    number = F.regexp_extract(t, r"[-+]?[0-9]+(?:\.[0-9]+)?", 0)
    warm = F.regexp_replace(F.format_string("%.2f", to_double(number) + 273.15), r"\.?0+$", "")
    return F.when(number == "", c).when(t.rlike(r"\b(?:k|kelvin)\b"), number).when(t.rlike("°\\s*c|º\\s*c|celsius"), warm).otherwise(c)


#: Molar mass, density of the usual solution and of the pure acid.
ACIDS = {
    "hcl": (36.46094, 1.19, 1.19),
    "hno3": (63.01284, 1.41, 1.51),
    "h2so4": (98.079, 1.84, 1.84),
    "h3po4": (97.994, 1.685, 1.885),
}
#: Names by which an acid is known.
ACID_NAMES = {"hcl": "hcl|hydrochloric", "hno3": "hno3|nitric", "h2so4": "h2so4|sulfuric|sulphuric", "h3po4": "h3po4|phosphoric"}


def acid_concentration(conc: Column, acid: Column) -> Column:
    """Struct ``molar, source``: a reported molarity, or one converted from weight or volume percent of a known acid; nulls otherwise."""
    both = F.concat_ws(" ", conc, acid)
    t = F.regexp_replace(F.regexp_replace(F.lower(both), "[^a-z0-9%()+./ -]+", " "), " +", " ")
    molar = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)\s*(?:mol\s*/?\s*l|mol\s*l-?1|m\b)", 1)
    percent = to_double(F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)\s*(?:wt|w/w|v/v)?\s*%", 1))
    which = F.coalesce(*[F.when(t.rlike(names), F.lit(a)) for a, names in ACID_NAMES.items()])

    def of(k: int) -> Column:
        return F.coalesce(*[F.when(which == a, F.lit(v[k])) for a, v in ACIDS.items()])

    volume = t.contains("v/v")
    value = F.when(volume, percent / 100.0 * of(2) * 1000.0 / of(0)).otherwise(percent * of(1) * 10.0 / of(0))
    source = F.when(volume, F.lit("converted_from_vv_percent")).otherwise(F.lit("converted_from_wt_percent"))
    return F.when(molar != "", F.struct(molar.alias("molar"), F.lit("reported_molar").alias("source"))).when(
        value.isNotNull(), F.struct(short_number(value).alias("molar"), source.alias("source"))
    ).otherwise(F.struct(F.lit(None).cast("string").alias("molar"), F.lit(None).cast("string").alias("source")))


def find_doi(c: Column) -> Column:
    """The first DOI of a text, without closing punctuation."""
    found = F.regexp_extract(c, r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+", 0)
    return F.when(found != "", F.regexp_replace(found, r"[.,;:)\]]+$", ""))


def guess_title(c: Column) -> Column:
    """Of the first 80 lines the first of 25 characters and five words or more that heads no section, else the first."""
    lines = F.filter(F.transform(F.slice(F.split(F.coalesce(c, F.lit("")), "\n"), 1, 80), strip), lambda x: x != "")
    good = F.filter(lines, lambda x: (F.length(x) >= 25) & (F.size(F.split(x, r"\s+")) >= 5) & ~F.lower(x).rlike("^(?:abstract|keywords|introduction)"))
    return F.coalesce(F.get(good, F.lit(0)), F.get(lines, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def chi2_survival(x: Column, df: int) -> Column:
    """Upper tail of chi squared for two degrees of freedom, exactly, and for one by the complementary error function's series."""
    if df == 2:
        return F.exp(-x / 2)
    # erfc(z) for z >= 0 by the rational form of Numerical Recipes, relative error below 1.2e-7
    z = F.sqrt(x / 2)
    t = 1 / (1 + z / 2)
    poly = F.lit(0.17087277)
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + k
    return t * F.exp(-z * z + poly)


def plain_filename(c: Column) -> Column:
    """A file name without the words for "main text, original" before it; null counts as empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "^主文[\\s_-]*原始[\\s_-]*", ""))


#: Base materials, in the order in which a suffix is tried; names of modified bases.
FAMILIES = ["PBC", "BC", "DC", "HC", "SC", "MB"]
FAMILY_ALIASES = {"APBC": "PBC", "OPBC": "PBC"}


def sample_family(c: Column) -> Column:
    """The base material of a sample id: an alias, the id itself, one of its tokens, its end, or else its letters and digits; blank gives an empty text."""
    sid = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))
    known = F.array(*[F.lit(f) for f in [*FAMILIES, *FAMILY_ALIASES]])

    def base(x: Column) -> Column:
        return F.coalesce(*[F.when(x == alias, F.lit(of)) for alias, of in FAMILY_ALIASES.items()], x)

    token = F.get(F.filter(F.split(sid, "[-_/]+"), lambda t: F.array_contains(known, t)), F.lit(0))
    compact = F.regexp_replace(sid, "[^A-Z0-9]", "")
    out = F.when(F.array_contains(known, sid), base(sid)).when(token.isNotNull(), base(token))
    for family in FAMILIES:
        out = out.when(compact.endswith(family) & (compact != family), F.lit(family))
    # an id of one letter and a family ends in that family, so it needs no rule of its own
    return out.when(compact != "", compact).otherwise(sid)


def is_base_of(c: Column, family: Column) -> Column:
    """An id that is its family's name and nothing else."""
    return (sample_key(c) == sample_key(family)) & (sample_key(c) != "")


def pick_url(doi: Column, link: Column) -> Column:
    """A link with a scheme as it is, else the DOI's resolver address, else the link."""
    d, u = strip(F.coalesce(doi, F.lit(""))), strip(F.coalesce(link, F.lit("")))
    return F.when(u.rlike("^https?://"), u).when(d != "", F.concat(F.lit("https://doi.org/"), d)).otherwise(u)


def plain_markup(c: Column) -> Column:
    """Table markup without layout attributes and elements; italic, bold and lowered text loses its tags and keeps its content; lines are not left empty."""
    out = F.regexp_replace(c, ' (xmlns|id|view|nameend|namest|valign)="[^"]+"', "")
    for element in ("(?:ce:)?hsp", "vsp", "colspec"):
        out = F.regexp_replace(out, f"<{element}[^>]*>.*?</{element}>", "")
    for element, attributes in (("italic", ""), ("bold", ""), ("inf", ' loc="post"')):
        out = F.regexp_replace(out, f"<(?:ce:)?{element}{attributes}>(.*?)</(?:ce:)?{element}>", "$1")
    return F.regexp_replace(F.regexp_replace(out, ' (frame|loc)="[^"]+"', ""), "\n+", "\n")


#: Extensions of files that are worth having, and what a content type says, in order.
FILE_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".zip", ".rar", ".txt", ".ppt", ".pptx", ".tsv", ".jpg", ".jpeg", ".png"]
CONTENT_TYPES = [
    ("pdf", ".pdf"), ("word", ".docx"), ("officedocument.wordprocessingml", ".docx"), ("excel", ".xlsx"), ("spreadsheetml", ".xlsx"),
    ("zip", ".zip"), ("csv", ".csv"), ("plain", ".txt"), ("jpeg", ".jpg"), ("png", ".png"),
]


def url_extension(url: Column) -> Column:
    """The lower-case extension of a URL's path, empty where there is none."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def file_extension(url: Column, content_type: Column) -> Column:
    """A known extension of the URL, else that of the content type, else ``.bin``."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.when(url_extension(url).isin(FILE_EXTENSIONS), url_extension(url))
    for word, extension in CONTENT_TYPES:
        out = out.when(kind.contains(word), F.lit(extension))
    return out.otherwise(F.lit(".bin"))


def general_number(x: Column) -> Column:
    """A number as C's ``%g`` writes it: six significant digits, no trailing zeros, an exponent below 1e-4 and from 1e6 on."""
    science = F.format_string("%.5e", x)
    power = F.regexp_extract(science, "e([-+][0-9]+)$", 1).cast("int")
    plain = F.format_string("%.10f", science.cast("double"))
    mantissa = F.regexp_extract(science, "^([^e]+)e", 1)

    def bare(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")

    return F.when(x.isNull(), None).when((power >= -4) & (power < 6), bare(plain)).otherwise(F.concat(bare(mantissa), F.regexp_extract(science, "(e[-+][0-9]+)$", 1)))


def whole_or_short(x: Column) -> Column:
    """A number as an integer if it is one within 1e-8, else with two decimals less trailing zeros."""
    near = F.round(x).cast("long")
    return F.when(F.abs(x - near) < 1e-8, near.cast("string")).otherwise(short_number(x, 2))


def approximate_tokens(c: Column) -> Column:
    """Tokens of a text where no tokenizer is given: a token for four characters, rounded up."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def has_number_about(c: Column, words: Sequence[str]) -> Column:
    """Whether a text has one of the words, in any case, and a digit."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return (F.size(keyword_hits(t, list(words))) > 0) & t.rlike("[0-9]")


def is_markdown_table(c: Column) -> Column:
    """A block of lines of which the first has a pipe and the second or third is a separator row."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), strip), lambda x: x != "")
    rule = F.exists(F.slice(lines, 2, 2), lambda x: x.rlike(r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"))
    return (F.size(lines) >= 2) & F.get(lines, F.lit(0)).contains("|") & rule


def markdown_blocks(c: Column) -> Column:
    """Array of ``kind, block``: the blocks between blank lines, each a ``table`` or ``text``."""
    blocks = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), strip), lambda x: x != "")
    return F.transform(blocks, lambda x: F.struct(F.when(is_markdown_table(x), F.lit("table")).otherwise(F.lit("text")).alias("kind"), x.alias("block")))


#: Words that say a sample was changed, left out of its alias.
ALIAS_WORDS = ["modified", "with", "treated"]


def sample_aliases(c: Column) -> Column:
    """The key of a sample id and that of the id without the words of ``ALIAS_WORDS``, once each, none empty."""
    short = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)\b(?:{'|'.join(ALIAS_WORDS)})\b", " ")
    return F.array_distinct(F.filter(F.array(alnum_key(c), alnum_key(short)), lambda x: x != ""))
