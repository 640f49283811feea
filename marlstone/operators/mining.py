"""Values, links and tables found in texts: typed patterns with context, candidate links, file association."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T


@dataclass(frozen=True)
class Pattern:
    """A number to be found: its field, a pattern whose first group is the number, the range of sensible values, and words of which one must stand within some characters before or after."""

    field: str
    pattern: str
    low: float
    high: float
    near: tuple[str, ...] = ()
    before: int = 0
    after: int = 0


#: What a method section says of heat treatment and acid treatment.
METHOD_PATTERNS = [
    Pattern("pyrolysis_temp_C", r"(?:pyrolys\w*|carboniz\w*|charred|calcined)[^.\n]{0,80}?(\d{2,4}(?:\.\d+)?)\s*(?:°\s*)?c", 100, 1300),
    Pattern("hold_duration_h", r"(?:hold(?:ing)?|residence|maintain(?:ed)?|kept|for)\s*(?:time\s*)?(?:of\s*)?(\d+(?:\.\d+)?)\s*h", 0.05, 200),
    Pattern("heating_rate_C_min", r"(\d+(?:\.\d+)?)\s*(?:°\s*)?c\s*/\s*min", 0.01, 200),
    Pattern("acid_conc_mol_L", r"(\d+(?:\.\d+)?)\s*(?:mol\s*/\s*l|m\b)", 0.001, 30, ("acid", "hcl", "hno3", "h2so4", "h3po4"), 40, 40),
    Pattern("acid_time_h", r"(\d+(?:\.\d+)?)\s*h", 0.01, 300, ("acid", "treated", "modif"), 60, 30),
    Pattern("acid_temp_C", r"(\d{2,3}(?:\.\d+)?)\s*(?:°\s*)?c", 0, 200, ("acid", "treated"), 60, 30),
]
#: Acids by what names them.
ACID_PATTERNS = [
    ("HCl", r"\bhcl\b|hydrochloric"), ("HNO3", r"\bhno3\b|nitric"), ("H2SO4", r"\bh2so4\b|sulfuric|sulphuric"), ("H3PO4", r"\bh3po4\b|phosphoric"),
    ("citric acid", "citric"), ("acetic acid", "acetic"), ("oxalic acid", "oxalic"),
]
PROCESS_FIELDS = ["pyrolysis_temp_C", "hold_duration_h", "heating_rate_C_min"]
ACID_FIELDS = ["acid_type", "acid_conc_mol_L", "acid_time_h", "acid_temp_C"]


def matches(text: Column, p: Pattern) -> Column:
    """Array of the numbers (as text) whose match has a word of ``near`` in its context.

    The text falls into what lies between matches and the matches; the context of a match is put
    together from as many of these as its length can need, so the work is linear in the matches.
    """
    if not p.near:
        return F.regexp_extract_all(text, F.lit(p.pattern), F.lit(1))

    def held(found: Column, numbers: Column, gaps: Column) -> Column:
        def near(i: Column) -> Column:
            def part(j: Column) -> Column:
                return F.concat(F.get(gaps, j), F.coalesce(F.get(found, j), F.lit("")))

            first, last = F.greatest(i - p.before, F.lit(0)), F.least(i + p.after, F.size(gaps) - 1)
            earlier = F.array_join(F.transform(F.filter(F.sequence(first, i), lambda j: j < i), part), "")
            later = F.array_join(F.transform(F.filter(F.sequence(i, last), lambda j: j > i), part), "")
            around = F.concat(F.right(F.concat(earlier, F.get(gaps, i)), F.lit(p.before)), F.get(found, i), F.left(later, F.lit(p.after)))
            return F.exists(F.array(*[F.lit(w) for w in p.near]), lambda w: F.contains(around, w))

        every = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(every, near), lambda i: F.get(numbers, i))

    def bound(t: Column) -> Column:
        found, numbers = F.regexp_extract_all(t, F.lit(p.pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(p.pattern), F.lit(1))
        parts = F.struct(found.alias("found"), numbers.alias("numbers"), F.split(t, p.pattern).alias("gaps"))
        return F.get(F.transform(F.array(parts), lambda x: held(x["found"], x["numbers"], x["gaps"])), F.lit(0))

    # bound first: written out, the whole text would be searched and split again for every match
    return F.get(F.transform(F.array(text), bound), F.lit(0))


def mined_values(docs: DataFrame, ident: str, text: str, patterns: Sequence[Pattern]) -> DataFrame:
    """``ident, field, value``: for each document and field the strictly most frequent number in range, written as ``%g``; a tie has no row."""
    low = docs.select(ident, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    each = [F.struct(F.lit(p.field).alias("field"), F.lit(float(p.low)).alias("low"), F.lit(float(p.high)).alias("high"), matches(F.col("_t"), p).alias("found")) for p in patterns]
    numbers = low.select(ident, F.inline(F.array(*each))).select(ident, "field", "low", "high", F.explode("found").alias("_n")).withColumn("_x", F.col("_n").try_cast("double"))
    numbers = numbers.where("_x >= low and _x <= high").select(ident, "field", T.general_number(F.col("_x")).alias("value"))
    return most_frequent(numbers, [ident, "field"], "value")


def most_frequent(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value``: the value that occurs more often than any other of its key; keys with a tie have no row. Counts are two numbers and a value for each key."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    tops = counts.groupBy(*keys, "_n").agg(F.min(value).alias(value), F.count("*").alias("_ways"))
    best = tops.groupBy(*keys).agg(F.max(F.struct("_n", "_ways", value)).alias("_b"))
    return best.where("_b._ways = 1").select(*keys, F.col(f"_b.{value}").alias(value))


def one_acid(text: Column) -> Column:
    """The acid a text names, where it names only one."""
    named = T.pattern_hits(F.lower(F.coalesce(text, F.lit(""))), ACID_PATTERNS)
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def texts_of_files(elements: DataFrame, folder: str, group: str, order: str, text: str, files: DataFrame, filename: str) -> DataFrame:
    """``filename, text`` for each file name seen in a folder (``files``: folder and file name), else for the folder's name with ``.pdf``: all element texts, cleaned ones last, with newlines between."""
    rank = F.when(F.col(group) == "elements", 0).otherwise(1)
    pieces = elements.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(folder, F.struct(rank.alias("g"), F.col(order).alias("o"), F.col(text).alias("t")).alias("_p"))
    whole = pieces.groupBy(folder).agg(F.array_sort(F.collect_list("_p")).alias("_p")).select(folder, F.array_join(F.transform("_p", lambda p: p.t), "\n").alias("text"))
    named = files.where(F.col(filename).isNotNull()).select(folder, F.col(filename).alias("filename")).distinct()
    return whole.join(named, folder, "left").select(F.coalesce("filename", F.concat(F.col(folder).cast("string"), F.lit(".pdf"))).alias("filename"), "text")


def backfill_from_text(rows: DataFrame, texts: DataFrame, patterns: Sequence[Pattern] = METHOD_PATTERNS, anywhere: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (``filename``, ``ord`` and fields) whose blanks take what their file's text says, and the fills (``ord, field, value, source``).

    Acid fields are filled only in rows that have an acid or say so in their sequence, or ``anywhere``.
    """
    key = T.alnum_key(F.regexp_replace("filename", r"^.*[/\\]", ""))
    keyed = texts.withColumn("_key", key).where("_key <> ''")
    mined = mined_values(keyed, "_key", "text", patterns)
    wide = mined.groupBy("_key").pivot("field", [p.field for p in patterns]).agg(F.first("value"))
    acid = keyed.select("_key", one_acid(F.col("text")).alias("acid_type")).where("acid_type is not null").groupBy("_key").agg(F.min("acid_type").alias("acid_type"), F.max("acid_type").alias("_m")).where("acid_type = _m").drop("_m")
    known = wide.join(acid, "_key", "full")
    found = known.select("_key", *[F.col(c).alias(f"_f_{c}") for c in known.columns if c != "_key"])
    acidic = F.lit(anywhere) | ~T.is_blank(F.col("acid_type")) | F.coalesce(F.lower("modification_sequence").contains("acid"), F.lit(False))
    joined = rows.withColumn("_key", key).join(found, "_key", "left").withColumn("_acidic", acidic)
    fields = [c for c in rows.columns if f"_f_{c}" in joined.columns]
    takes = {c: F.when(T.is_blank(F.col(c)) & (F.col("_acidic") if c in ACID_FIELDS else F.lit(True)), F.col(f"_f_{c}")) for c in fields}
    marked = joined.withColumns({f"_t_{c}": take for c, take in takes.items()})
    log = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_t_{c}").alias("value")) for c in fields]), lambda x: x.value.isNotNull())
    fills = marked.select("ord", F.inline(log)).withColumn("source", F.lit("method_text"))
    return marked.select(*[F.coalesce(f"_t_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns]), fills


#: What makes a link a candidate for supplementary files.
LINK_KEYWORDS = [
    "supplementary information", "supporting information", "supplementary material", "supplementary materials", "electronic supplementary material", "appendix", "additional file", "dataset",
]
LINK_HINTS = ["supp", "suppl", "supplement", "supporting", "esm", "moesm", "mediaobjects", "additional", "dataset"]
LINK_EXCLUDED = ["graphical abstract"]
_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"


def link_score(label: Column, url: Column, keywords: Sequence[str] = LINK_KEYWORDS, hints: Sequence[str] = LINK_HINTS, excluded: Sequence[str] = LINK_EXCLUDED) -> Column:
    """5 for each keyword, 2 for each hint, 8 for a known file extension, 2 for a download; -999 for what is excluded."""
    whole = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(url, F.lit(""))))
    score = 5 * F.size(T.keyword_hits(whole, keywords)) + 2 * F.size(T.keyword_hits(whole, hints))
    score = score + 8 * T.url_extension(url).isin(T.FILE_EXTENSIONS).cast("int") + 2 * whole.contains("download").cast("int")
    return F.when(F.size(T.keyword_hits(whole, excluded)) > 0, F.lit(-999)).otherwise(score).cast("int")


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` as seen from a page: absolute ones stay, ``//host`` takes the scheme, ``/path`` the host, ``?query`` and ``#part`` the page, all else the page's folder (``./`` and leading ``../`` resolved)."""
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(host, F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/")))
    up = F.regexp_replace(folder, r"[^/]+/$", "")
    page = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(host, href))
        .when(href.startswith("#"), F.concat(page, href))
        .when(href.startswith("?"), F.concat(host, path, href))
        .when(href.startswith("../"), F.concat(F.when(F.length(up) > F.length(host), up).otherwise(F.concat(host, F.lit("/"))), F.substring(href, F.lit(4), F.length(href))))
        .when(href.startswith("./"), F.concat(folder, F.substring(href, F.lit(3), F.length(href))))
        .otherwise(F.concat(folder, href))
    )


def page_links(pages: DataFrame, ident: str, url: str, html: str) -> DataFrame:
    """``ident, label, url``: the anchors of a page with an address, once each; tags and repeated space in labels go."""
    anchors = pages.select(ident, F.col(url).alias("_base"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_ANCHOR), F.lit(0))).alias("_a"))
    href = T.strip(F.coalesce(*[F.nullif(F.regexp_extract("_a", rf"(?is)^<a\b[^>]*?\bhref\s*=\s*{quoted}", 1), F.lit("")) for quoted in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")]))
    label = T.collapse(F.regexp_replace(F.regexp_extract("_a", _ANCHOR, 2), "<[^>]*>", " "))
    found = anchors.select(ident, label.alias("label"), "_base", href.alias("_href")).where("_href <> ''")
    return found.select(ident, "label", absolute_url(F.col("_base"), F.col("_href")).alias("url")).distinct()


def candidate_links(links: DataFrame, ident: str, most: int = 12, **words: Sequence[str]) -> DataFrame:
    """``links`` of a positive score with ``score`` and ``rank``: the best first, by URL and label on equal scores, ``most`` for each page."""
    scored = links.withColumn("score", link_score(F.col("label"), F.col("url"), **words)).where("score > 0")
    order = Window.partitionBy(ident).orderBy(F.desc("score"), "url", "label")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def supplements_of(files: DataFrame, folder: str, name: str) -> DataFrame:
    """``folder, main, name``: supplements and the articles they belong to, within a folder.

    A supplement belongs to the one article of its folder, or to any whose stem (supplement words off, letters and digits) its own
    stem contains; a file without supplement words belongs to an article by containment alone.
    """
    stem = T.alnum_key(F.regexp_replace(name, r"\.[^.]*$", ""))
    own = files.select(folder, F.col(name).alias("name"), stem.alias("_stem"), T.is_supplement(F.col(name)).alias("_si"), F.lower(name).endswith(".pdf").alias("_pdf"))
    mains = own.where("_pdf and not _si").select(folder, F.col("name").alias("main"), T.alnum_key(T.paper_key(F.col("name"))).alias("_root"))
    alone = mains.groupBy(folder).agg(F.count("*").alias("_mains"))
    both = own.join(mains.join(alone, folder), folder).where("name <> main")
    return both.where((F.col("_si") & (F.col("_mains") == 1)) | ((F.col("_root") != "") & F.contains("_stem", F.col("_root")))).select(folder, "main", "name")
