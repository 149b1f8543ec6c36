"""Rows from recognised words on a page: a table of words (doc, page, text, x, y) in, item lines out.

A page is small and its rows depend on order, so rows are clustered page by page in Arrow groups; all else is joins and
windows over the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats  # noqa: F401  (rates of the picker)
from .relational import latest_per_key, zip_join

PAGE = ["doc", "page"]
MONEY = r"^\$?-?\d{1,3}(?:,?\d{3})*\.\d{2}-?$"


def rows_by_running_mean(words: DataFrame, tolerance: float) -> DataFrame:
    """words with `row`: from top to bottom, a word starts a row when it is further than the tolerance from the mean of
    the row so far."""
    import pandas as pd
    from pyspark.sql.types import LongType, StructField, StructType

    def cluster(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x", "text"], kind="stable").reset_index(drop=True)
        rows, row, total, n = [], -1, 0.0, 0
        for y in page["y"]:
            if n == 0 or abs(y - total / n) > tolerance:
                row, total, n = row + 1, 0.0, 0
            total, n = total + y, n + 1
            rows.append(row)
        page["row"] = rows
        return page

    schema = StructType([*words.schema.fields, StructField("row", LongType())])
    return words.groupBy(*PAGE).applyInPandas(cluster, schema)


def row_texts(words: DataFrame) -> DataFrame:
    """(doc, page, row, y, text): each row's words from left to right."""
    ordered = F.array_sort(F.collect_list(F.struct("x", "text")))
    return words.groupBy(*PAGE, "row").agg(F.avg("y").alias("y"), F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def section_headers(lines: DataFrame, names: list[str]) -> DataFrame:
    """lines (doc, page, row, text) with header (the section a line names between runs of asterisks, or null) and section
    (the last header so far, carried over pages)."""
    from ..functions import text

    starred = F.rlike("text", F.lit(r"\*{2,}"))
    label = F.trim(F.regexp_replace("text", r"\*+", " "))
    known = text.section_name(label, names, F.lit(None).cast("string"))
    out = lines.withColumn("header", F.when(starred, known))
    w = Window.partitionBy("doc").orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("section", F.last("header", ignorenulls=True).over(w))


def by_columns(words: DataFrame, bands: dict[str, tuple[float, float]], joined: tuple[str, ...] = ("description",)) -> DataFrame:
    """(doc, page, row, *columns): words of each row by the band of x that they lie in. Columns in `joined` are all their
    words from left to right, the others the first word that is there. A vendor's layout is its bands."""
    band = None
    for name, (lo, hi) in bands.items():
        hit = (F.col("x") >= lo) & (F.col("x") < hi)
        band = F.when(hit, name) if band is None else band.when(hit, name)
    placed = words.withColumn("_band", band).where("_band IS NOT NULL")

    def column(name: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("_band") == name, F.struct("x", "text"))))
        texts = F.transform(own, lambda w: w["text"])
        return (F.array_join(texts, " ") if name in joined else F.get(texts, 0)).alias(name)

    return placed.groupBy(*PAGE, "row").agg(*[column(n) for n in bands])


def amount(c: Column) -> Column:
    """A number as printed: with commas, a currency sign, and a minus before or after; else null."""
    digits = F.regexp_replace(c, r"[$,\s-]", "")
    number = F.when(F.rlike(digits, F.lit(r"^\d+(?:\.\d+)?$")), digits.try_cast("double"))
    return F.when(F.rlike(F.trim(c), F.lit(r"^-|-$")), -number).otherwise(number)


def spatial_items(words: DataFrame, bands: dict[str, tuple[float, float]], tolerance: float, sections: list[str]) -> DataFrame:
    """(doc, page, row, section, quantity, description, unit_price, extended): rows that have a description and a sum.

    bands must name quantity, description, unit_price and extended; a row without a sum continues the description of
    the item above it.
    """
    rows = rows_by_running_mean(words, tolerance)
    headed = section_headers(row_texts(rows), sections).select(*PAGE, "row", "section", "header")
    cells = by_columns(rows, bands).join(headed, [*PAGE, "row"]).where("header IS NULL")
    cells = cells.withColumn("_e", amount(F.col("extended")))
    w = Window.partitionBy(*PAGE).orderBy("row")
    cells = cells.withColumn("_item", F.count(F.when(F.col("_e").isNotNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_item > 0")
    words_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.coalesce("description", F.lit("")).alias("d")))), lambda r: r["d"]), " ")
    first = lambda c: F.min_by(c, "row")
    items = cells.groupBy(*PAGE, "_item").agg(
        F.min("row").alias("row"), first("section").alias("section"), amount(first("quantity")).alias("quantity"), F.trim(words_of).alias("description"),
        amount(first("unit_price")).alias("unit_price"), first("_e").alias("extended"),
    )
    return items.where("description != ''").drop("_item")


def rank_pairs(words: DataFrame, quantity: tuple[float, float], price: tuple[float, float], extended: tuple[float, float], tolerance: float) -> DataFrame:
    """(doc, page, k, quantity, unit_price, extended, ambiguous): columns that were recognised one after another, paired
    by rank from the top: the k-th quantity with the k-th price, and with the sum nearest to it within the tolerance.

    A page is ambiguous when its columns have different numbers of words; the longer one's rest falls away.
    """
    column = lambda span, name: words.where((F.col("x") >= span[0]) & (F.col("x") < span[1])).select(*PAGE, amount(F.col("text")).alias(name), F.col("y").alias(f"{name}_y")).where(F.col(name).isNotNull())
    q, p, e = column(quantity, "quantity"), column(price, "unit_price"), column(extended, "extended")
    pairs = zip_join(q, p, PAGE, [F.col("quantity_y")], [F.col("unit_price_y")])
    counts = q.groupBy(*PAGE).agg(F.count("*").alias("_q")).join(p.groupBy(*PAGE).agg(F.count("*").alias("_p")), PAGE, "full_outer")
    near = pairs.join(e, PAGE).where(F.abs(F.col("extended_y") - F.col("unit_price_y")) <= tolerance)
    best = near.groupBy(*PAGE, "k").agg(F.min_by("extended", F.struct(F.abs(F.col("extended_y") - F.col("unit_price_y")), "extended_y")).alias("extended"))
    out = pairs.join(best, [*PAGE, "k"], "left").join(counts, PAGE)
    return out.select(*PAGE, "k", "quantity", "unit_price", "extended", (~F.col("_q").eqNullSafe(F.col("_p"))).alias("ambiguous"))


#: Price rules of a printed price: by the case, by the unit, by the pound.
PRICE_UNITS = {"CS": "case", "CASE": "case", "EA": "each", "EACH": "each", "LB": "pound", "#": "pound"}


def unit_prices(words: DataFrame, tolerance: float, units: dict[str, str] = PRICE_UNITS) -> DataFrame:
    """(doc, page, unit, basis, price, dy): each unit word with the price word nearest to it in height, right of it,
    within the tolerance; a price belongs to one unit, the nearest."""
    table = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    u = words.where(F.upper("text").isin(*units)).select(*PAGE, F.upper("text").alias("unit"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    p = words.where(F.rlike("text", F.lit(MONEY))).select(*PAGE, amount(F.col("text")).alias("price"), F.col("x").alias("px"), F.col("y").alias("py"))
    met = u.join(p, PAGE).where((F.abs(F.col("uy") - F.col("py")) <= tolerance) & (F.col("px") > F.col("ux"))).withColumn("dy", F.abs(F.col("uy") - F.col("py")))
    best = latest_per_key(met, [*PAGE, "unit", "ux", "uy"], [F.col("dy"), F.col("px") - F.col("ux"), F.col("py")])
    best = latest_per_key(best, [*PAGE, "px", "py"], [F.col("dy"), F.col("ux").desc(), F.col("uy")])
    return best.select(*PAGE, "unit", F.element_at(table, F.col("unit")).alias("basis"), "price", "dy")


def text_items(lines: DataFrame, pattern: str, fields: list[str], ends: str | None = None) -> DataFrame:
    """(doc, page, row, *fields): lines that a vendor's pattern matches, a group for each field, and before the line that
    ends the items (the first that `ends` matches)."""
    rows = lines
    if ends is not None:
        w = Window.partitionBy("doc").orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_over", F.max(F.rlike("text", F.lit(ends)).cast("int")).over(w)).where("_over = 0").drop("_over")
    hit = rows.where(F.rlike("text", F.lit(pattern)))
    return hit.select(*PAGE, "row", *[F.trim(F.regexp_extract("text", pattern, i + 1)).alias(f) for i, f in enumerate(fields)])


def parsed_by_vendor(lines: DataFrame, vendors: DataFrame, patterns: dict[str, tuple[str, str | None]], fields: list[str], fallback: str) -> DataFrame:
    """text_items of each document under its vendor's pattern; documents of other vendors, or of which the vendor's
    pattern finds nothing, under the fallback. vendors: (doc, vendor)."""
    with_vendor = lines.join(vendors, "doc", "left")
    out = None
    for vendor, (pattern, ends) in patterns.items():
        part = text_items(with_vendor.where(F.col("vendor") == vendor).drop("vendor"), pattern, fields, ends)
        out = part if out is None else out.unionByName(part)
    rest = lines.join(out.select("doc").distinct(), "doc", "left_anti") if out is not None else lines
    other = text_items(rest, fallback, fields)
    return other if out is None else out.unionByName(other)


def pick_extractor(candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, extractor): which extractor's items an invoice takes.

    candidates: (doc, extractor: rank, spatial or text, n, total, sections_ok, placeholders, with_quantity). With a
    printed total: most sections reconciled, fewest placeholders, a gap under 0.50, of those most rows with a quantity,
    the smallest gap, then rank before spatial before text. Without: rank if there, else spatial if it has as many rows
    as text, else text. totals: (doc, printed).
    """
    c = candidates.join(totals, "doc", "left").withColumn("_gap", F.abs(F.col("total") - F.col("printed")))
    place = F.when(F.col("extractor") == "rank", 0).when(F.col("extractor") == "spatial", 1).otherwise(2)
    close = F.col("_gap") < 0.50
    coverage = F.when(close, F.coalesce(F.try_divide(F.col("with_quantity"), F.col("n")), F.lit(0.0))).otherwise(0.0)
    order = [F.col("sections_ok").desc(), F.col("placeholders"), close.desc(), coverage.desc(), F.col("_gap"), place]
    with_total = latest_per_key(c.where("printed IS NOT NULL"), ["doc"], order).select("doc", "extractor")
    n_of = lambda name: F.max(F.when(F.col("extractor") == name, F.col("n")))
    none = c.where("printed IS NULL").groupBy("doc").agg(n_of("rank").alias("r"), n_of("spatial").alias("s"), n_of("text").alias("t"))
    choice = F.when(F.col("r").isNotNull(), "rank").when(F.col("s") >= F.coalesce("t", F.lit(0)), "spatial").otherwise("text")
    return with_total.unionByName(none.select("doc", choice.alias("extractor")))


def with_charges(items: DataFrame, fees: DataFrame, totals: DataFrame, fee_share: float = 0.20, rest_share: float = 0.08) -> DataFrame:
    """items (doc, description, extended, synthetic) with fees of an invoice as lines where they come to at most a share
    of its total, and with what then is left to the total as one line where that is under another share."""
    fee = fees.groupBy("doc").agg(F.sum("amount").alias("_fees")).join(totals, "doc").where(F.col("_fees") <= fee_share * F.col("printed")).select("doc")
    more = fees.join(fee, "doc", "left_semi").select("doc", "description", F.col("amount").alias("extended"), F.lit(True).alias("synthetic"))
    both = items.select("doc", "description", "extended", "synthetic").unionByName(more)
    sums = both.groupBy("doc").agg(F.sum("extended").alias("_sum")).join(totals, "doc")
    left = F.round(F.col("printed") - F.col("_sum"), 2)
    rest = sums.where((left > 0) & (left < rest_share * F.col("printed"))).select("doc", F.lit("residual charges").alias("description"), left.alias("extended"), F.lit(True).alias("synthetic"))
    return both.unionByName(rest)


def group_totals(words: DataFrame, headers: DataFrame, label: str = r"(?i)^(?:GROUP\s+)?TOTAL") -> DataFrame:
    """(doc, page, section, labelled, largest): the number beside a total's label in each section's range of a page, and
    the largest number there. headers: (doc, page, y, section); a range goes from its header to the next one's."""
    w = Window.partitionBy(*PAGE).orderBy("y")
    spans = headers.select(*PAGE, "section", F.col("y").alias("_from"), F.coalesce(F.lead("y").over(w), F.lit(float("inf"))).alias("_to"))
    numbers = words.where(F.rlike("text", F.lit(MONEY))).select(*PAGE, amount(F.col("text")).alias("v"), F.col("y").alias("_y"), F.col("x").alias("_x"))
    labels = words.where(F.rlike("text", F.lit(label))).select(*PAGE, F.col("y").alias("_ly"), F.col("x").alias("_lx"))
    inside = numbers.join(spans, PAGE).where((F.col("_y") > F.col("_from")) & (F.col("_y") < F.col("_to")))
    largest = inside.groupBy(*PAGE, "section").agg(F.max("v").alias("largest"))
    beside = inside.join(labels, PAGE).where((F.abs(F.col("_ly") - F.col("_y")) <= 0.5) & (F.col("_x") > F.col("_lx")) & (F.col("_ly") > F.col("_from")) & (F.col("_ly") < F.col("_to")))
    labelled = beside.groupBy(*PAGE, "section").agg(F.max_by("v", "_y").alias("labelled"))
    return spans.select(*PAGE, "section").join(labelled, [*PAGE, "section"], "left").join(largest, [*PAGE, "section"], "left")


def columns_of_peaks(words: DataFrame, width: float, share: float) -> DataFrame:
    """(doc, page, column, x): the left edges where words of a page begin most: bins of `width` that hold at least `share`
    of the page's rows and no less than the bins beside them."""
    bins = words.withColumn("bin", F.floor(F.col("x") / width)).groupBy(*PAGE, "bin").agg(F.countDistinct("row").alias("n"), F.min("x").alias("x"))
    total = words.groupBy(*PAGE).agg(F.countDistinct("row").alias("_rows"))
    w = Window.partitionBy(*PAGE).orderBy("bin")
    beside = lambda f: F.when(F.abs(f("bin").over(w) - F.col("bin")) == 1, f("n").over(w))
    peaks = bins.withColumn("_l", beside(F.lag)).withColumn("_r", beside(F.lead)).join(total, PAGE)
    peaks = peaks.where((F.col("n") >= share * F.col("_rows")) & (F.col("n") >= F.coalesce("_l", F.lit(0))) & (F.col("n") > F.coalesce("_r", F.lit(0))))
    return peaks.select(*PAGE, (F.row_number().over(w) - 1).cast("long").alias("column"), "x")


def table_cells(words: DataFrame, tolerance: float, width: float = 2.0, share: float = 0.5) -> DataFrame:
    """(doc, page, row, column, text): a table without lines, from its words: rows by height, columns by where words begin."""
    rows = rows_by_running_mean(words, tolerance)
    edges = columns_of_peaks(rows, width, share).groupBy(*PAGE).agg(F.array_sort(F.collect_list("x")).alias("_edges"))
    column = F.greatest(F.size(F.filter("_edges", lambda e: e <= F.col("x"))) - 1, F.lit(0)).cast("long")
    placed = rows.join(edges, PAGE).withColumn("column", column)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*PAGE, "row", "column").agg(texts.alias("text"))


def tilt(words: DataFrame, left: tuple[float, float], right: tuple[float, float], least: int = 3) -> DataFrame:
    """(doc, page, tilt): the median difference in height of the k-th words of two columns, with `least` words in each."""
    side = lambda span, name: words.where((F.col("x") >= span[0]) & (F.col("x") < span[1])).select(*PAGE, F.col("y").alias(name))
    pairs = zip_join(side(left, "a"), side(right, "b"), PAGE, [F.col("a")], [F.col("b")])
    return pairs.groupBy(*PAGE).agg(F.median(F.col("b") - F.col("a")).alias("tilt"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")


def page_order(lines: DataFrame) -> DataFrame:
    """(doc, page, key): a page's place, by "page k of n", else first for an invoice's head, last for its totals."""
    stated = F.max(F.nullif(F.regexp_extract(F.upper("text"), r"\bPAGE\s*:?\s*(\d+)", 1), F.lit("")).cast("long"))
    head = F.max(F.rlike(F.upper("text"), F.lit(r"\b(?:BILL TO|SHIP TO|INVOICE DATE)\b")).cast("int"))
    foot = F.max(F.rlike(F.upper("text"), F.lit(r"\b(?:INVOICE TOTAL|ORDER SUMMARY|LAST PAGE)\b")).cast("int"))
    cues = lines.groupBy(*PAGE).agg(stated.alias("_s"), head.alias("_h"), foot.alias("_f"))
    return cues.select(*PAGE, F.coalesce("_s", F.when(F.col("_f") == 1, 9999), F.when(F.col("_h") == 1, 0), F.lit(500)).cast("long").alias("key"))
