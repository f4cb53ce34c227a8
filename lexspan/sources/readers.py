"""Readers of documents into units (see schemas.UNIT). A unit's place is (source_path, pos); unit_idx numbers the units of a
document in that order."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan import schemas
from lexspan.functions.text import DELETED, clean_text, normalize_label, strip

SUFFIXES = ("json", "md", "markdown", "txt", "pdf")
HEADING = r"^(#{1,6})(?U)\s+(.*)$"


def _whole(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, value of whole text files under a path."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.substring_index(path, "/", -1)), r"\.[^.]*$", "")


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("source_path", "pos")
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in schemas.UNIT_COLUMNS if c != "unit_idx"]
    return rows.withColumn("unit_idx", (F.row_number().over(order) - 1).cast("long")).select("unit_idx", *blank)


def laws(spark: SparkSession, path: str) -> DataFrame:
    """schemas.LAW with source_path of JSON files, one law each. A field that isn't a string fails the job."""
    return checked_laws(_whole(spark, path, "*.json").where(~F.endswith("path", F.lit("/manifest.json"))))


def checked_laws(raw: DataFrame) -> DataFrame:
    """The same of texts (path, value)."""
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    text = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")).isin("STRING", "VOID"), F.lit(True))
    whole = v.isNotNull() & F.startswith(kind, F.lit("OBJECT")) & text("name") & text("nature") & text("url") & text("last_amended") & text("effective_date")
    # every leaf of an article is a string
    leaves = ~F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.articles", "variant")), F.lit("VOID")).rlike(r":\s*(BIGINT|DOUBLE|DECIMAL|BOOLEAN)")
    checked = raw.withColumn("_ok", F.assert_true(whole & leaves & (F.coalesce(strip(F.try_variant_get(v, "$.name", "string")), F.lit("")) != ""), F.concat(F.lit("not a law: "), F.col("path"))))
    return checked.where("_ok is null").select(F.from_json("value", schemas.LAW).alias("law"), F.col("path").alias("source_path")).select("law.*", "source_path")


def law_units(records: DataFrame) -> DataFrame:
    """A unit for each article that has text and isn't deleted."""
    each = records.select(
        strip(F.col("name")).alias("doc_id"), strip(F.col("name")).alias("doc_title"), "source_path", strip(F.col("url")).alias("source_url"),
        strip(F.col("last_amended")).alias("last_amended"), strip(F.col("effective_date")).alias("effective_date"), F.posexplode("articles").alias("pos", "a"),
    )
    units = each.withColumns({"text": clean_text(F.col("a.content")), "article_no": normalize_label(F.coalesce("a.no", F.lit(""))), "chapter": normalize_label(F.coalesce("a.chapter", F.lit("")))})
    return _numbered(units.where((F.col("text") != "") & ~F.col("text").rlike(DELETED)))


def markdown_units(texts: DataFrame) -> DataFrame:
    """A unit for each headed section with a body; its chapter is the path of headings. texts: path, value.

    A heading of each level holds until one of its level or above comes: six running maxima, no fold.
    """
    lines = texts.select("path", F.posexplode(F.split(clean_text(F.col("value")), "\n")).alias("pos", "line"))
    level = F.char_length(F.regexp_extract("line", HEADING, 1))
    marked = lines.withColumn("level", F.when(level > 0, level)).withColumn("title", F.when(level > 0, strip(F.regexp_extract("line", HEADING, 2))))
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_h{k}": F.max(F.when(F.col("level") == k, F.struct("pos", "title"))).over(w) for k in range(1, 7)}
    above = {f"_r{k}": F.max(F.when(F.col("level") < k, F.col("pos"))).over(w) for k in range(1, 7)}
    held = marked.withColumn("section", F.count("level").over(w)).withColumns(last).withColumns(above)
    holds = [F.when(F.col(f"_h{k}.pos") > F.coalesce(F.col(f"_r{k}"), F.lit(-1)), F.col(f"_h{k}.title")) for k in range(1, 7)]
    body = held.withColumn("chapter", F.concat_ws(" > ", *holds)).where("level is null")
    rows = body.groupBy("path", "section").agg(F.first("chapter").alias("chapter"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    units = rows.withColumn("text", strip(F.col("text"))).where("text <> ''")
    return _numbered(units.select(_stem(F.col("path")).alias("doc_id"), _stem(F.col("path")).alias("doc_title"), "chapter", "text", F.col("path").alias("source_path"), F.col("section").alias("pos")))


def text_units(texts: DataFrame) -> DataFrame:
    """A unit for each file that has text."""
    units = texts.select(_stem(F.col("path")).alias("doc_id"), _stem(F.col("path")).alias("doc_title"), clean_text(F.col("value")).alias("text"), F.col("path").alias("source_path"), F.lit(0).alias("pos"))
    return _numbered(units.where("text <> ''"))


def pypdf_pages(raw: bytes) -> list[str]:
    from pypdf import PdfReader  # an optional library

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]


def pdf_units(files: DataFrame, pages: Callable[[bytes], list[str]] = pypdf_pages) -> DataFrame:
    """A unit for each page with text. files: path, content. pages: the texts of a file's pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                found = pages(bytes(raw))
                yield pd.DataFrame({"path": path, "pos": range(1, len(found) + 1), "value": found})

    each = files.select("path", "content").mapInPandas(run, "path string, pos int, value string")
    units = each.select(
        _stem(F.col("path")).alias("doc_id"), _stem(F.col("path")).alias("doc_title"), clean_text(F.col("value")).alias("text"), F.col("path").alias("source_path"), "pos",
        F.concat(F.lit("第 "), F.col("pos").cast("string"), F.lit(" 頁")).alias("chapter"),
    )
    return _numbered(units.where("text <> ''"))


def corpus(spark: SparkSession, path: str, *, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Units of all files of known kinds under a path, by suffix in lower case; others are skipped. A malformed law fails the job."""
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = binary.withColumn("suffix", suffix)
    texts = kind.select("path", "suffix", F.decode("content", "UTF-8").alias("value"))
    parts = [
        law_units(checked_laws(texts.where("suffix = 'json' and not endswith(path, '/manifest.json')").select("path", "value"))),
        markdown_units(texts.where("suffix in ('md', 'markdown')")), text_units(texts.where("suffix = 'txt'")),
    ]
    if pdf:
        parts.append(pdf_units(kind.where("suffix = 'pdf'"), pdf))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    """Units of one kind of file, told by the path's suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "json":
        return law_units(laws(spark, path))
    if suffix in ("md", "markdown"):
        return markdown_units(_whole(spark, path, "*"))
    if suffix == "txt":
        return text_units(_whole(spark, path, "*"))
    if suffix == "pdf":
        return pdf_units(spark.read.format("binaryFile").load(path).select("path", "content"))
    raise ValueError(f"unsupported file type: {suffix}")


def zip_nodes(files: DataFrame) -> DataFrame:
    """path, law, child, tag, value: children of each law in the largest XML member of zip files, in document order.

    The order in which chapters and articles stand is what gives an article its chapter, and Spark's XML reader groups children
    by tag; so the member is read as a stream of elements, a file a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    member = max((m for m in z.infolist() if m.filename.lower().endswith(".xml")), key=lambda m: m.file_size)
                    rows, law = [], 0
                    with z.open(member) as stream:
                        for _, e in ElementTree.iterparse(stream):
                            if e.tag != "法規":
                                continue
                            n = 0
                            for c in e.iter():
                                if c is not e and not len(c):
                                    rows.append((path, law, n, c.tag, c.text or ""))
                                    n += 1
                            law += 1
                            e.clear()
                            if len(rows) > 5000:
                                yield pd.DataFrame(rows, columns=["path", "law", "child", "tag", "value"])
                                rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["path", "law", "child", "tag", "value"])

    return files.select("path", "content").mapInPandas(run, "path string, law long, child long, tag string, value string")


def zip_laws(nodes: DataFrame) -> DataFrame:
    """Law records of zip_nodes(): an article belongs to the last chapter before it."""
    w = Window.partitionBy("path", "law").orderBy("child")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    text = strip(F.col("value"))
    each = nodes.withColumns({
        "chapter": F.last(F.when(F.col("tag") == "編章節", text), ignorenulls=True).over(upto),
        "no": F.last(F.when(F.col("tag") == "條號", text), ignorenulls=True).over(upto),
    })
    one = lambda t: F.coalesce(F.max(F.when(F.col("tag") == t, text)), F.lit(""))
    article = F.when(F.col("tag") == "條文內容", F.struct("child", F.struct(F.coalesce("no", F.lit("")).alias("no"), F.coalesce("chapter", F.lit("")).alias("chapter"), text.alias("content")).alias("a")))
    return each.groupBy("path", "law").agg(
        one("法規名稱").alias("name"), one("法規性質").alias("nature"), one("法規網址").alias("url"), one("最新異動日期").alias("last_amended"), one("生效日期").alias("effective_date"),
        one("廢止註記").alias("abolished"), F.transform(F.array_sort(F.collect_list(article)), lambda x: x["a"]).alias("articles"),
    ).withColumnRenamed("path", "source_path").drop("law")


def zip_status(files: DataFrame) -> DataFrame:
    """path, status: ok, not_a_zip, damaged, no_xml, entities or no_law."""

    def look(raw: bytes) -> str:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                if z.testzip():
                    return "damaged"
                members = [m for m in z.infolist() if m.filename.lower().endswith(".xml") and m.file_size]
                if not members:
                    return "no_xml"
                with z.open(max(members, key=lambda m: m.file_size)) as s:
                    body = s.read()
                return "entities" if re.search(rb"<!ENTITY", body) else "ok" if "<法規>".encode() in body else "no_law"
        except (zlib.error, RuntimeError, NotImplementedError):  # a broken stream, an encrypted member, an unknown method
            return "damaged"
        except (zipfile.BadZipFile, EOFError, OSError):
            return "not_a_zip"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "status": [look(bytes(x)) for x in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, status string")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a line that isn't an object of the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
