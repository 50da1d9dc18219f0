"""Reading a vault's files: markdown pages, clips, JSON stores, event logs, office documents and web pages."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T


def relative(path: Column, root: str) -> Column:
    """A file's path below the root, decoded."""
    prefix = re.sub(r"^file:/*", "/", root.rstrip("/")) + "/"
    plain = F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^file:/*", "/")
    return F.substring(plain, len(prefix) + 1, 4096)


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, modified, size, content`` of all files below the root but those with a part that begins with a dot."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = raw.select(relative(F.col("path"), root).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return rows.filter(~F.col("path").rlike(r"(^|/)\."))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All files as pages: markdown parsed by patterns, anything else an attachment that keeps its extension in its name."""
    f = files(spark, root)
    text = F.when(F.col("path").rlike(r"(?i)\.md$"), F.decode("content", "UTF-8"))
    f = f.withColumn("text", text).withColumn("is_md", F.col("text").isNotNull()).drop("content")
    f = f.withColumn("fm", T.frontmatter(F.col("text"))).withColumn("body", T.body(F.col("text")))
    fm = F.col("fm")
    date = lambda n: F.try_to_date(F.left(T.field(fm, n), F.lit(10)), "yyyy-MM-dd")
    return f.select(
        "path", F.lower(T.file_name(F.col("path"))).alias("name"), F.coalesce(T.field(fm, "title"), F.nullif(F.regexp_extract("body", r"(?m)^# +(.*?)[ \t\r]*$", 1), F.lit(""))).alias("title"),
        "is_md", "text", "fm", "body", T.field(fm, "status").alias("status"), F.when(F.col("is_md"), T.field(fm, "type")).otherwise("attachment").alias("type"),
        date("created").alias("created"), date("updated").alias("updated"), date("reviewed").alias("reviewed"), T.field(fm, "project").alias("project"), T.field(fm, "kind").alias("kind"),
        T.field(fm, "decision-status").alias("decision_status"), T.field(fm, "backlog-status").alias("backlog_status"), T.callouts(F.col("body")).alias("update_callout_count"),
        T.field(fm, "source").alias("source"), T.field(fm, "topic").alias("topic"), F.lower(T.field(fm, "source-hash")).alias("source_hash"), T.hash_list(fm).alias("source_hashes"),
        F.when(F.col("is_md"), T.word_count(F.col("body"))).otherwise(0).alias("words"), T.wikilinks(F.coalesce("body", F.lit(""))).alias("out_targets"), T.wikilinks(F.coalesce(fm, F.lit(""))).alias("fm_targets"),
        F.coalesce(T.declares_no_sources(fm), F.lit(False)).alias("declares_no_sources"), "modified", "size",
    )


def links_of(pages: DataFrame) -> DataFrame:
    """Links of scanned pages as ``source, pos, channel, target``."""
    side = lambda c, channel: pages.select(F.col("path").alias("source"), F.posexplode(c).alias("pos", "target")).select("source", "pos", F.lit(channel).alias("channel"), "target")
    return side("out_targets", "nav").unionByName(side("fm_targets", "prov"))


def event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON in file order with ``seq``; blank and broken lines are skipped."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parsed = lines.withColumn("e", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("e is not null and e._bad is null").select("seq", "e.*").drop("_bad")


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object per file; files that cannot be read give no rows."""
    rows = spark.read.schema(schema + ", _bad string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null").drop("_bad")


def manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Purge manifests as entries ``purge_id, entry, from_path, source_hash, url`` and the files that cannot be read."""
    schema = "id string, topic string, date string, entries array<struct<layer:string,`from`:string,sha256:string,`source-hash`:string,url:string>>, declines array<string>, _bad string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path).withColumn("file", F.input_file_name())
    good = rows.filter("_bad is null and id is not null")
    e = good.select(F.col("id").alias("purge_id"), F.posexplode("entries").alias("entry", "x"))
    return e.select("purge_id", "entry", F.col("x.from").alias("from_path"), F.col("x.source-hash").alias("source_hash"), F.col("x.url").alias("url")), rows.filter("_bad is not null or id is null").select("file")


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """``domain``: lines of a text file in lower case, blank lines and comments dropped."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("domain")).filter((F.col("domain") != "") & ~F.col("domain").startswith("#"))


class _Page(html.parser.HTMLParser):
    """Title, description and the text of the main element of a page."""

    SKIP = {"script", "style", "nav", "aside", "footer", "header", "form", "noscript", "svg", "button"}
    BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "blockquote", "pre", "br", "figure"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.skip, self.main = "", "", 0, 0
        self.in_title, self.all, self.inner, self.has_main = False, [], [], False

    def _put(self, x: str) -> None:
        self.all.append(x)
        if self.main:
            self.inner.append(x)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
        elif tag == "meta" and (a.get("name") or a.get("property") or "").lower() in ("description", "og:description"):
            self.description = self.description or a.get("content") or ""
        elif tag in self.SKIP:
            self.skip += 1
        elif tag in ("article", "main"):
            self.main += 1
            self.has_main = True
        if tag in self.BLOCK and not self.skip:
            self._put("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in self.BLOCK and not self.skip:
            self._put("\n")
        if tag in ("article", "main"):
            self.main = max(0, self.main - 1)

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self._put(re.sub(r"\s+", " ", data))


def extract_html(markup: str | None) -> tuple[str, str, str, int]:
    """Title, description, text of the main element (or of all but navigation) as light markdown, and its number of words."""
    p = _Page()
    try:
        p.feed(markup or "")
        p.close()
    except Exception:  # a page that cannot be parsed has what was read so far
        pass
    text = "".join(p.inner if p.has_main else p.all)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", text)).strip()
    return " ".join(p.title.split()), " ".join(p.description.split()), text, len(text.split())


def extract_pages(df: DataFrame, key: str, markup: str) -> DataFrame:
    """``key, title, description, text, words`` of web pages, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *extract_html(m)) for k, m in zip(b["k"], b["m"])]
            yield pd.DataFrame(rows, columns=[key, "title", "description", "text", "words"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(markup).alias("m")).mapInPandas(run, f"`{key}` {kind}, title string, description string, text string, words int")


def _zip_xml(content: bytes, names: re.Pattern) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(n, z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if names.search(n)]


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word document."""
    import xml.etree.ElementTree as ET

    out = []
    for _, xml in _zip_xml(content, re.compile(r"word/document\.xml$")):
        for p in ET.fromstring(xml).iter("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}p"):
            out.append("".join(t.text or "" for t in p.iter("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t")))
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(out)).strip()


def xlsx_text(content: bytes) -> str:
    """Sheets of a workbook as lines of cells between bars."""
    import xml.etree.ElementTree as ET

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared: list[str] = []
    for _, xml in _zip_xml(content, re.compile(r"xl/sharedStrings\.xml$")):
        shared = ["".join(t.text or "" for t in si.iter(ns + "t")) for si in ET.fromstring(xml).iter(ns + "si")]
    out = []
    for _, xml in _zip_xml(content, re.compile(r"xl/worksheets/sheet\d+\.xml$")):
        for row in ET.fromstring(xml).iter(ns + "row"):
            cells = []
            for c in row.iter(ns + "c"):
                v = c.find(ns + "v")
                text = "".join(t.text or "" for t in c.iter(ns + "t")) if v is None else v.text or ""
                cells.append(shared[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text)
            out.append("| " + " | ".join(cells) + " |")
        out.append("")
    return "\n".join(out).strip()


def extract_office(df: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """``key, text, error`` of ``.docx`` and ``.xlsx`` files; ``.pdf`` only where a library for it is installed."""

    def one(name: str, data: bytes) -> tuple[str | None, str | None]:
        try:
            low = name.lower()
            if low.endswith(".docx"):
                return docx_text(data), None
            if low.endswith(".xlsx"):
                return xlsx_text(data), None
            if low.endswith(".pdf"):
                import pypdf

                return "\f".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages), None
            return None, "unknown kind"
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:300]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *one(p, bytes(c))) for k, p, c in zip(b["k"], b["p"], b["c"])], columns=[key, "text", "error"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, f"`{key}` {kind}, text string, error string")
