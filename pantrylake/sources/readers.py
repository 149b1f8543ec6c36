"""Sources and sinks: Parquet, CSV, JSON with bad records kept apart, binary listings, idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | StructType, required: list[str]) -> DataFrame:
    """A CSV with header and a given schema; rows without the required columns fall away."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    for c in required:
        df = df.where(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return df


def headcount_events(df: DataFrame) -> DataFrame:
    """(day, delta): '(3)' is -3."""
    number = F.regexp_replace("delta", r"[()]", "").cast("int")
    return df.select(F.to_date("day").alias("day"), F.when(F.startswith(F.trim("delta"), F.lit("(")), -number).otherwise(number).alias("delta"))


def json_documents(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad): documents of a schema, and the text of those that do not parse."""
    raw = spark.read.option("wholetext", True).text(path)
    parsed = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d"))
    some = F.coalesce(*[F.col(f"d.{f.name}").cast("string") for f in schema.fields]).isNotNull()
    return parsed.where(some).select("d.*"), parsed.where(~some).select("value")


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, sha256, size): files of a folder, told apart by their ending."""
    files = spark.read.format("binaryFile").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ending == "csv", "csv").when(ending.isin("pdf", "png", "jpg", "jpeg", "tif", "tiff"), "image").otherwise("other")
    return files.select("path", kind.alias("kind"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def word_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(page, token, text, x, y): OCR pages of JSON documents as rows."""
    schema = "struct<pages: array<struct<page_number:int, tokens: array<struct<text:string, x_min:double, x_max:double, y_min:double, y_max:double>>>>>"
    docs = spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("d"))
    pages = docs.select(F.explode("d.pages").alias("p"))
    return pages.select(F.col("p.page_number").alias("page"), F.posexplode("p.tokens").alias("token", "t")).select("page", "token", "t.text", ((F.col("t.x_min") + F.col("t.x_max")) / 2).alias("x"), ((F.col("t.y_min") + F.col("t.y_max")) / 2).alias("y"))


def write_month(df: DataFrame, path: str, day: str) -> None:
    """Replace the months that `df` holds, and only those."""
    df.withColumn("ym", F.date_format(day, "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path)


def headcounts(events: DataFrame) -> DataFrame:
    """(day, headcount): running sum of dated changes, a row for each day from the first event to the last."""
    from pyspark.sql import Window

    sums = events.groupBy("day").agg(F.sum("delta").alias("delta"))
    spine = events.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    # one row a day: a short calendar, whatever the number of events
    running = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(sums, "day", "left").select("day", F.sum(F.coalesce("delta", F.lit(0))).over(running).cast("long").alias("headcount"))


def price_list(spark: SparkSession, path: str, vendors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(prices, errors) of a vendors' price list with header vendor,sku,unit,description,list_price,discount_pct: the last
    row of each (vendor, sku, unit); rows of unknown vendors, without sku or with a price that is no number are errors."""
    raw = spark.read.option("header", True).csv(path).withColumn("_at", F.monotonically_increasing_id())
    price, discount = F.col("list_price").try_cast("decimal(18,4)"), F.coalesce(F.col("discount_pct").try_cast("decimal(5,4)"), F.lit(0).cast("decimal(5,4)"))
    why = F.when(~F.coalesce(F.upper(F.trim("vendor")).isin(*[v.upper() for v in vendors]), F.lit(False)), "unknown vendor").when(F.trim(F.coalesce("sku", F.lit(""))) == "", "no sku").when(price.isNull(), "no price")
    rows = raw.withColumn("error", why)
    from ..operators.relational import latest_per_key

    good = rows.where("error IS NULL").select(F.trim("vendor").alias("vendor"), F.trim("sku").alias("sku"), F.upper(F.trim(F.coalesce("unit", F.lit("")))).alias("unit"), "description", price.alias("list_price"), discount.alias("discount"), "_at")
    good = latest_per_key(good, ["vendor", "sku", "unit"], [F.desc("_at")]).drop("_at")
    net = (F.col("list_price") * (1 - F.col("discount"))).cast("decimal(18,4)")
    return good.withColumn("net_price", net), rows.where("error IS NOT NULL").drop("_at")


def budget(spark: SparkSession, path: str) -> DataFrame:
    """(ym, vendor, day, total) of a budget sheet without header: day, vendor, amount in the first three columns, other
    rows (headings, sums, blanks) left out."""
    raw = spark.read.csv(path)
    c = [F.col(x) for x in raw.columns[:3]]
    day = F.coalesce(*[F.try_to_timestamp(F.trim(c[0]), F.lit(p)).cast("date") for p in ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy")])
    total = F.regexp_replace(c[2], r"[$,\s]", "").try_cast("decimal(18,2)")
    rows = raw.select(day.alias("day"), F.trim(c[1]).alias("vendor"), total.alias("total"))
    return rows.where("day IS NOT NULL AND total IS NOT NULL AND vendor != ''").select(F.date_format("day", "yyyy-MM").alias("ym"), "vendor", "day", "total")


TOTALS = "vendor string, date string, total double, source_file string, invoice_number string"


def monthly_totals(spark: SparkSession, path: str) -> DataFrame:
    """Monthly totals written as JSON arrays; missing files and broken ones count as empty."""
    try:
        raw = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(path)
    except Exception as e:  # a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TOTALS)
    return raw.select(F.explode(F.from_json("value", f"array<struct<{TOTALS.replace(' string', ':string').replace(' double', ':double')}>>", {"mode": "PERMISSIVE"})).alias("t")).select("t.*").where("vendor IS NOT NULL")


def append_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Totals after a write: of the same vendor, day and amount one row, that with an invoice number before others, and
    new before old; of the same invoice number the new one."""
    from pyspark.sql import Window

    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    number = F.nullif(F.trim(F.coalesce("invoice_number", F.lit(""))), F.lit(""))
    same = Window.partitionBy(F.lower("vendor"), "date", "total").orderBy(number.isNull(), F.desc("_new"), number, "source_file")
    both = both.withColumn("_k", F.row_number().over(same)).where("_k = 1")
    again = Window.partitionBy(F.lower("vendor"), F.coalesce(number, F.concat_ws("|", "date", F.col("total").cast("string")))).orderBy(F.desc("_new"), F.desc("date"), "total")
    return both.withColumn("_k", F.row_number().over(again)).where("_k = 1").drop("_k", "_new")


def write_totals(df: DataFrame, path: str) -> None:
    """A JSON file of each month's totals, replacing the months that `df` holds."""
    df.withColumn("ym", F.substring("date", 1, 7)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").json(path)


def budget_push(rows: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, failed): rows whose (day, vendor in lower case) the sheet lacks, one for each; undated rows fail."""
    from ..operators.relational import latest_per_key

    key = [F.col("day"), F.lower(F.trim("vendor")).alias("_v")]
    dated = rows.where("day IS NOT NULL").withColumn("_v", F.lower(F.trim("vendor")))
    new = dated.join(sheet.select(*key).distinct(), ["day", "_v"], "left_anti")
    return latest_per_key(new, ["day", "_v"], [F.desc("total")]).select(*rows.columns), rows.where("day IS NULL")


def dish_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(dish, services, prepped, wasted) of a JSON document with an array of dishes."""
    schema = "struct<dishes: array<struct<name:string, services:int, total_prepped:double, total_wasted:double>>>"
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", schema)["dishes"]).alias("d"))
    return raw.select(F.col("d.name").alias("dish"), F.col("d.services").alias("services"), F.col("d.total_prepped").alias("prepped"), F.col("d.total_wasted").alias("wasted"))


def mapping_tables(mappings: DataFrame) -> dict[str, DataFrame]:
    """The four look-ups of a mapping table (vendor, description, code, name, category, primary, secondary): by code, by
    description, by vendor and description, and the categories of a name; the first name of equals."""
    from ..operators.resolution import normalized

    key, least = normalized(F.col("description")), F.min("name").alias("name")
    with_key = mappings.withColumn("key", key).where("key != ''")
    return {
        "code": mappings.where("code IS NOT NULL AND code != ''").groupBy("code").agg(least),
        "description": with_key.groupBy("key").agg(least),
        "vendor_description": with_key.where("vendor IS NOT NULL AND vendor != ''").groupBy(F.upper("vendor").alias("vendor"), "key").agg(least),
        "category": mappings.groupBy("name").agg(*[F.min(c).alias(c) for c in ("category", "primary", "secondary")]),
    }


def relational(spark: SparkSession, url: str, table_name: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database; with a numeric key it is read in `parts` ranges of it at once."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return reader.option("dbtable", table_name).load()
    low, high = reader.option("dbtable", f"(SELECT MIN({key}) AS a, MAX({key}) AS b FROM {table_name}) x").load().first()
    reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", table_name)
    if low is None:
        return reader.load()
    return reader.option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts).load()


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _sheet_cells(content: bytes):
    """(sheet, row, column, value) of a workbook: a zip of XML parts."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for title, part in zip(titles, parts):
            for cell in ElementTree.fromstring(z.read(part)).iter(f"{_MAIN}c"):
                letters, number = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "s" and value is not None:
                    text = shared[int(value.text)]
                elif cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                else:
                    text = value.text if value is not None else None
                if text is not None:
                    yield title, int(number), column, text


def _document_blocks(content: bytes):
    """(block, kind, row, column, text, style) of a text document, in order: paragraphs, and cells of tables."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    said = lambda e: "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in e.iter(f"{_WORD}p"))
    for block, element in enumerate(body):
        if element.tag == f"{_WORD}p":
            style = element.find(f"{_WORD}pPr/{_WORD}pStyle")
            yield block, "paragraph", 0, 0, said_of(element), style.get(f"{_WORD}val") if style is not None else None
        elif element.tag == f"{_WORD}tbl":
            for r, row in enumerate(element.iter(f"{_WORD}tr")):
                for c, cell in enumerate(row.iter(f"{_WORD}tc")):
                    yield block, "cell", r, c, said(cell), None


def said_of(paragraph) -> str:
    return "".join(t.text or "" for t in paragraph.iter(f"{_WORD}t"))


def _files(read, names: list[str]):
    """A mapInArrow function that gives the rows `read` finds in each file; a file that is no such document gives none."""

    def run(batches):
        import zipfile
        from xml.etree import ElementTree

        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(path, *r) for r in read(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            types = [pa.int64() if n in ("row", "column", "block") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return run


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, column, text): the cells of workbooks, read where the files are."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_files(_sheet_cells, ["path", "sheet", "row", "column", "text"]), "path string, sheet string, row long, column long, text string")


def document_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, kind, row, column, text, style): paragraphs and cells of text documents, read where the files are."""
    names = ["path", "block", "kind", "row", "column", "text", "style"]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_files(_document_blocks, names), "path string, block long, kind string, row long, column long, text string, style string")


def production_slots(cells: DataFrame, slots: dict[int, str]) -> DataFrame:
    """(path, sheet, day, slot, dish, quantity, unit) of a tracker: a column of dishes for each slot with amounts beside
    it ("12 lb"). A row whose first cell is a date starts a day; headings and amounts without a number are left out."""
    from pyspark.sql import Window

    text = F.trim("text")
    day = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("M/d/yyyy"))).cast("date")
    days = cells.where("column = 1").select("path", "sheet", "row", day.alias("day")).where("day IS NOT NULL")
    dishes = cells.where(F.col("column").isin(*slots)).select("path", "sheet", "row", "column", text.alias("dish"))
    amounts = cells.select("path", "sheet", "row", (F.col("column") - 1).alias("column"), text.alias("amount"))
    both = dishes.join(amounts, ["path", "sheet", "row", "column"])
    both = both.withColumn("day", F.lit(None).cast("date")).unionByName(days, allowMissingColumns=True)
    w = Window.partitionBy("path", "sheet").orderBy("row", F.col("dish").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("day", F.last("day", ignorenulls=True).over(w)).where("dish IS NOT NULL AND dish != '' AND day IS NOT NULL")
    number, unit = F.regexp_extract("amount", r"^(\d+(?:\.\d+)?)\s*([A-Za-z]*)$", 1).try_cast("double"), F.regexp_extract("amount", r"^(\d+(?:\.\d+)?)\s*([A-Za-z]*)$", 2)
    slot = F.element_at(F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]), F.col("column").cast("int"))
    return both.select("path", "sheet", "day", slot.alias("slot"), "dish", number.alias("quantity"), F.lower(unit).alias("unit")).where("quantity IS NOT NULL")


def recipe_document(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipes, ingredients) of recipe documents: (path, recipe, serves) and (path, recipe, position, quantity, unit, name).

    A heading starts a recipe; "serves n" or "yield: n" in a paragraph states its servings; a table's rows under it are
    ingredients: quantity with unit, name.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("block", "row", "column").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.startswith(F.lower(F.coalesce("style", F.lit(""))), F.lit("heading")) & (F.trim("text") != "")
    rows = blocks.withColumn("recipe", F.last(F.when(heading, F.trim("text")), ignorenulls=True).over(w)).where("recipe IS NOT NULL")
    said = F.regexp_extract(F.lower("text"), r"(?:serves|yields?|servings)\s*:?\s*(\d+)", 1).try_cast("int")
    recipes = rows.groupBy("path", "recipe").agg(F.min_by(said, F.when(said.isNotNull(), F.col("block"))).alias("serves"))
    cells = rows.where("kind = 'cell'").groupBy("path", "recipe", "block", "row").pivot("column", [0, 1]).agg(F.first("text"))
    amount = r"^(\d+(?:\.\d+)?(?:\s*/\s*\d+)?)\s*(.*)$"
    number = F.regexp_extract(F.trim("0"), amount, 1)
    value = F.when(F.contains(number, F.lit("/")), F.try_divide(F.split_part(number, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(number, F.lit("/"), F.lit(2)).try_cast("double"))).otherwise(number.try_cast("double"))
    place = Window.partitionBy("path", "recipe").orderBy("block", "row")
    ingredients = cells.where(F.trim(F.coalesce("1", F.lit(""))) != "").select("path", "recipe", F.row_number().over(place).cast("long").alias("position"), value.alias("quantity"), F.nullif(F.trim(F.regexp_extract(F.trim("0"), amount, 2)), F.lit("")).alias("unit"), F.trim("1").alias("name"))
    return recipes, ingredients


def menu_grid(blocks: DataFrame, year: int) -> DataFrame:
    """(path, day, slot, dish) of a menu grid: a table whose first row has days ("Mon 1/5") and whose first column has
    slots; each line of a cell is a dish."""
    cells = blocks.where("kind = 'cell'")
    date = F.regexp_extract("text", r"(\d{1,2})/(\d{1,2})", 1), F.regexp_extract("text", r"(\d{1,2})/(\d{1,2})", 2)
    days = cells.where("row = 0").select("path", "block", "column", F.try_to_date(F.concat_ws("-", F.lit(str(year)), F.lpad(date[0], 2, "0"), F.lpad(date[1], 2, "0")), "yyyy-MM-dd").alias("day")).where("day IS NOT NULL")
    slots = cells.where("column = 0 AND row > 0").select("path", "block", "row", F.lower(F.trim("text")).alias("slot"))
    dishes = cells.where("column > 0 AND row > 0").select("path", "block", "row", "column", F.explode(F.split("text", "\n")).alias("dish")).where("trim(dish) != ''")
    return dishes.join(days, ["path", "block", "column"]).join(slots, ["path", "block", "row"]).select("path", "day", "slot", F.trim("dish").alias("dish"))


def guide_attributes(blocks: DataFrame, names: list[str]) -> DataFrame:
    """(path, dish, attribute, value) of a guide: a heading names a dish, lines "attribute: value" under it describe it."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.startswith(F.lower(F.coalesce("style", F.lit(""))), F.lit("heading"))
    rows = blocks.where("kind = 'paragraph'").withColumn("dish", F.last(F.when(heading, F.trim("text")), ignorenulls=True).over(w)).where("dish IS NOT NULL")
    name, value = F.lower(F.trim(F.split_part("text", F.lit(":"), F.lit(1)))), F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1))
    return rows.where(~heading & F.contains("text", F.lit(":"))).select("path", "dish", name.alias("attribute"), value.alias("value")).where(F.col("attribute").isin(*names) & (F.col("value") != ""))


def portions(cells: DataFrame) -> DataFrame:
    """(doc, category, item, measure) of a portion table's cells (layout.table_cells): a row with only a first cell is a
    category, one with two or more an item and its measure."""
    from pyspark.sql import Window

    rows = cells.groupBy("doc", "page", "row").agg(F.array_sort(F.collect_list(F.struct("column", "text"))).alias("c"))
    rows = rows.withColumn("n", F.size("c")).withColumn("a", F.trim(F.get("c", 0)["text"])).withColumn("b", F.trim(F.get("c", 1)["text"]))
    w = Window.partitionBy("doc").orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("category", F.last(F.when(F.col("n") == 1, F.col("a")), ignorenulls=True).over(w))
    return rows.where("n >= 2 AND category IS NOT NULL").select("doc", "category", F.col("a").alias("item"), F.col("b").alias("measure"))


def fetched(cache: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(answers, still to fetch): a remote look-up's cached answers by key, and the keys without one."""
    one = cache.dropDuplicates([key])
    return wanted.join(one, key), wanted.select(key).distinct().join(one, key, "left_anti")


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def restore(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def report(df: DataFrame, path: str | None, dry_run: bool = True) -> list[str]:
    """Rows of a small report as JSON lines; written to `path` unless it is a dry run (the default)."""
    rows = df.toJSON().collect()
    if path is not None and not dry_run:
        df.write.mode("overwrite").json(path)
    return rows
