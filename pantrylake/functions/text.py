"""Text expressions: keys, tokens, stems and overlap. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

#: Plural suffixes, the least length of a word that has one, characters to drop, and what comes instead.
#: They are narrow, so that cookies, brownies and shoes keep their singulars.
PLURALS = (("rries", 6, 3, "y"), ("ovies", 7, 3, "y"), ("atoes", 6, 2, ""), ("goes", 5, 2, ""), ("ches", 5, 2, ""), ("shes", 5, 2, ""), ("xes", 4, 2, ""))


def description_key(c: Column) -> Column:
    """Upper case, slashes as spaces, single spaces."""
    return F.upper(F.trim(F.regexp_replace(F.replace(c, F.lit("/"), F.lit(" ")), r"\s+", " ")))


def dedup_key(c: Column) -> Column:
    """Without white space and without a leading single-letter token."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]\s+", ""), r"\s+", ""))


def stem(word: Column) -> Column:
    """A plural's singular by suffix; -ss words and words under four letters without a listed suffix stay."""
    w = F.lower(word)
    out = None
    for suffix, least, drop, put in PLURALS:
        hit = F.endswith(w, F.lit(suffix)) & (F.length(w) >= least)
        cut = F.concat(F.substr(w, F.lit(1), F.length(w) - drop), F.lit(put))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.when((F.length(w) >= 4) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def stems(c: Column) -> Column:
    """The stems of all words of three letters or more, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z]{3,})"), F.lit(1)), stem)


def overlap(a: Column, b: Column) -> Column:
    """Two texts share a stem."""
    return F.coalesce(F.arrays_overlap(stems(a), stems(b)), F.lit(False))


def expanded(c: Column, table: dict[str, str] = tables.ABBREVIATIONS) -> Column:
    """Abbreviations in full, in either case, where no letter stands beside them; of several at one place the longest.

    One pass: the text is cut at the abbreviations, and what was cut out is looked up.
    """
    keys = sorted(table, key=lambda k: (-len(k), k))
    pattern = "(?i)(?<![A-Za-z])(?:" + "|".join(rf"\Q{k}\E" for k in keys) + ")(?![A-Za-z])"
    full = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda k: F.element_at(full, F.upper(k)))
    return F.array_join(F.zip_with(F.split(c, pattern, -1), F.array_append(found, F.lit("")), lambda gap, word: F.concat(gap, word)), "")


def accents_folded(c: Column) -> Column:
    """Letters without their marks, by compatibility decomposition; what is not ASCII after that falls away.

    The decomposition is the ICU library's that Spark brings for its collations.
    """
    return F.regexp_replace(F.when(F.octet_length(c) == F.length(c), c).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(True))), r"[^\x00-\x7F]", "")


def charge(c: Column, phrases: list[str] = tables.CHARGES) -> Column:
    """A surcharge, fee or credit, and no good."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.upper(F.coalesce(c, F.lit(""))), p))


def _without_sections(c: Column) -> Column:
    names = "|".join(tables.SECTIONS)
    return F.trim(F.regexp_replace(c, rf"(?i)\*+|\b(?:CANNED\s*&?\s*DRY|CHEMICAL\s*&?\s*JANITORIAL|PAPER\s*&?\s*DISP|{names})\b", ""))


def junk(c: Column, code: Column, price: Column, extended: Column, synthetic: Column, marks_substitutes: Column, lines: list[str] = tables.JUNK_LINES, phrases: list[str] = tables.JUNK_PHRASES) -> Column:
    """A line that is no item: blank, only a number, a placeholder in brackets, a run of asterisks, or a known wording.

    Four exceptions stay: charges that were put there on purpose; a placeholder with a code of 6 characters or more and a
    price over 5; a section's header run into a text of 5 characters or more, with such a code and a price over 1; and,
    for vendors that mark substitutes by asterisks, a text of 10 characters or more with a sum over 5.
    """
    t = F.trim(F.coalesce(c, F.lit("")))
    line = F.upper(F.regexp_replace(t, r"\s+", " "))
    stars, placeholder = F.rlike(t, F.lit(r"\*{2,}")), F.rlike(t, F.lit(r"^\[[^\]]*#\d+\]$"))
    hit = (
        (t == "") | F.rlike(t, F.lit(r"^[\d\s.,/]+$")) | placeholder | F.rlike(t, F.lit(r"\*{3,}")) | line.isin(*lines)
        | F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(line, p))
    )
    coded = F.length(F.coalesce(code.cast("string"), F.lit(""))) >= 6
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    rest = F.length(_without_sections(t))
    kept = (
        F.coalesce(synthetic, F.lit(False))
        | (placeholder & coded & (number(price) > 5))
        | (stars & coded & (number(price) > 1) & (rest >= 5))
        | (F.coalesce(marks_substitutes, F.lit(False)) & stars & (number(extended) > 5) & (rest >= 10))
    )
    return hit & ~kept


def boilerplate(c: Column, phrases: list[str] = ["CUSTOMER'S ORIGINAL", "TRUCK STOP"]) -> Column:  # noqa: B006
    """An address, a telephone number, a box number, a state with its code, or a known phrase instead of an item.

    Only letters that the post assigns are a state: "XX 12345" is a vendor's item code.
    """
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    shapes = [r"^P\.?O\.?\s*BOX", r"^\d{3}[-.]\d{3}[-.]\d{4}$", r"^\(\d{3}\)\s*\d{3}[-.]\d{4}$", rf"^(?:{'|'.join(tables.STATES)})\s+\d{{5}}(?:-\d{{4}})?$", r"^\d{2,5}\s+[NSEW]\s+[A-Z]+", r"^DRIVER'?S\s+SIGN"]
    out = t.isin(*phrases)
    for p in shapes:
        out = out | F.rlike(t, F.lit(p))
    return out


def proposed_name(c: Column, brands: str | None = None, table: dict[str, str] = tables.ABBREVIATIONS) -> Column:
    """A clean name from a raw description, or null: abbreviations in full, without brand, trailing code and leading
    quantities, each part between commas as singular title-case words without noise.

    brands: a pattern of brand codes; one that is left after the first makes the text unusable.
    """
    quantity = r"(?i)^\s*[#c-]?\s*\d+(?:\s*[#/×x-]\s*\d+)?\s*(?:OZ|LB|GAL|CT|CS|DZ|EA|PK|BG|BX|CN|KG|ML|GR|G|QT|PT|CONT)?\b\s*"
    t = F.trim(expanded(c, table))
    if brands:
        t = F.trim(F.regexp_replace(t, rf"(?i)^(?:{brands})\s+", ""))
    t = F.regexp_replace(t, r"[\s,]*\d{6,}\w*\s*$", "")
    words = lambda part: F.regexp_extract_all(F.regexp_replace(part, quantity, ""), F.lit(r"([A-Za-z][A-Za-z']*)"), F.lit(1))
    noise = F.array(*map(F.lit, tables.NAME_NOISE))
    clean = lambda part: F.array_join(F.transform(F.filter(words(F.trim(part)), lambda w: ~F.array_contains(noise, F.lower(w))), lambda w: F.initcap(stem(w))), " ")
    name = F.array_join(F.filter(F.transform(F.split(t, ","), clean), lambda p: p != ""), ", ")
    spoilt = F.rlike(t, F.lit(rf"(?i)\b(?:{brands})\b")) if brands else F.lit(False)
    return F.when((F.length(name) >= 3) & ~spoilt, name)


def tokens(c: Column) -> Column:
    """Distinct upper-case tokens: words of two letters or more, and numbers with compound marks."""
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"([A-Z][A-Z]+|[0-9]+(?:[/.,%-][0-9]+)*%?)"), F.lit(1)))


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap over union of two token sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def missing_qualifier(canonical: Column, raw: Column, qualifiers: list[str]) -> Column:
    """The canonical name has a qualifier that the raw one lacks."""
    return F.size(F.array_except(F.array_intersect(canonical, F.array(*map(F.lit, qualifiers))), raw)) > 0


def word_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(F.lower(c)), r"\s+")), " ")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c)


def nearest_fraction(c: Column) -> Column:
    """Whole part and the nearest common fraction within 0.02, else two decimals."""
    whole, rest = F.floor(c), c - F.floor(c)
    #: The fractions that are shown.
    shown = ((1, 4), (1, 3), (1, 2), (2, 3), (3, 4))
    out = F.when(F.abs(rest) < 0.02, whole.cast("string"))
    for a, b in shown:
        out = out.when(F.abs(rest - a / b) <= 0.02, F.concat(F.when(whole > 0, F.concat(whole.cast("string"), F.lit(" "))).otherwise(""), F.lit(f"{a}/{b}")))
    return out.otherwise(F.format_string("%.2f", c.cast("double")))


def naive_stem(word: Column) -> Column:
    """Lower case; words over three letters lose a final s."""
    w = F.lower(word)
    return F.when((F.length(w) > 3) & F.endswith(w, F.lit("s")), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)


#: Units that recognition runs into the capitals after them.
GLUED_UNITS = ["OZ", "LB", "GAL", "CT", "CS", "DZ", "EA", "KG", "ML"]


def ocr_clean(c: Column) -> Column:
    """Blanks where recognition ran words together: after a number whose O of OZ was read as a zero (which is dropped),
    and after a unit that four capitals or more follow."""
    ounces = F.regexp_replace(c, r"(?<=\d)0Z\b", " OZ")
    return F.regexp_replace(ounces, rf"\b(?:{'|'.join(GLUED_UNITS)})(?=[A-Z]{{4}})", "$0 ")


def strip_edges(c: Column, lead: str, brand: str, tail: str, least: int = 5) -> Column:
    """Without a leading pattern, a brand and up to two trailing patterns, where `least` characters or more remain."""
    cut = lambda s, p: F.trim(F.regexp_replace(s, p, ""))
    out = cut(cut(c, rf"^(?:{lead})"), rf"^(?:{brand})")
    for _ in range(2):
        shorter = cut(out, rf"(?:{tail})$")
        out = F.when(F.length(shorter) >= least, shorter).otherwise(out)
    return F.when((F.length(out) >= least) & (F.length(out) < F.length(c)), out).otherwise(c)


def first_group(c: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches; null where none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def section_name(label: Column, names: list[str], otherwise: Column | None = None) -> Column:
    """The first canonical name that a label contains, else the label itself (or `otherwise`)."""
    out = None
    for n in names:
        hit = F.contains(F.upper(label), F.lit(n))
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(label if otherwise is None else otherwise)


def ending_stem(word: Column) -> Column:
    """Lower case; -ies as -y and -es cut from words over four letters, then a single s from words over three."""
    w = F.lower(word)
    cut = lambda k: F.substr(w, F.lit(1), F.length(w) - k)
    ends = lambda x: F.endswith(w, F.lit(x))
    return F.when((F.length(w) > 4) & ends("ies"), F.concat(cut(3), F.lit("y"))).when((F.length(w) > 4) & ends("es"), cut(2)).when((F.length(w) > 3) & ends("s") & ~ends("ss"), cut(1)).otherwise(w)


def stripped_stem(word: Column) -> Column:
    """Lower case without any s at the end."""
    return F.regexp_replace(F.lower(word), "s+$", "")


def annotations_stripped(c: Column, notes: tuple[str, ...] = ("NO SPLITS", "SPLIT ONLY", "MIN ORDER")) -> Column:
    """Without a vendor's remarks (in brackets or not), with single blanks and none before punctuation."""
    bare = F.regexp_replace(c, rf"\(?\s*(?:{'|'.join(notes)})\s*\)?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+([,;/])", "$1"), r"\s+", " "))


def invoice_number(page: Column, vendor: Column, patterns: dict[str, list[str]]) -> Column:
    """An invoice's number: by its vendor's patterns, by a label, or, where the number stands below the label, the first
    run of six digits or more after the word; null where none is."""
    label = [r"(?i)invoice\s*(?:no\.?|number|num|#)\s*[:#.]*\s*([A-Z]?-?\d{2,})", r"(?i)\binv\s*[#.:]+\s*([A-Z]?-?\d+)"]
    own = [F.when(vendor == v, first_group(page, rules)) for v, rules in patterns.items()]
    return F.coalesce(*own, first_group(page, label), first_group(page, [r"(?is)\binvoice\b.*?\b(\d{6,})\b"]))
