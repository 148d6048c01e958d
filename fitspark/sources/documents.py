"""Documents in files: text, DOCX and PDF, with an optional reader of images."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import Protocol
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitspark.cluster import ship
from fitspark.functions import text
from fitspark.sources.sections import merge_lines

try:
    import fitz  # PyMuPDF
except ImportError:
    fitz = None

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Pages that are read as images, and crops of each.
OCR_PAGES = 5
CROPS = ("full", "left", "right", "top", "bottom")


class ImageReader(Protocol):
    """Reads the text in a PNG; it must be picklable."""

    def read(self, png: bytes) -> str: ...


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX, one a line; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_NS}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD_NS}t")) for p in body.findall(f"{WORD_NS}p"))


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page. Needs PyMuPDF."""
    if fitz is None:
        raise RuntimeError("reading PDF needs PyMuPDF")
    with fitz.open(stream=content, filetype="pdf") as d:
        return [p.get_text() for p in d]


def pdf_crops(content: bytes) -> list[list[bytes]]:
    """Images of the first pages, CROPS of each, at 200 dpi. Needs PyMuPDF."""
    out = []
    with fitz.open(stream=content, filetype="pdf") as d:
        for page in list(d)[:OCR_PAGES]:
            r = page.rect
            w, h = r.width, r.height
            boxes = [r, fitz.Rect(0, 0, w / 2, h), fitz.Rect(w / 2, 0, w, h), fitz.Rect(0, 0, w, h / 2), fitz.Rect(0, h / 2, w, h)]
            out.append([page.get_pixmap(dpi=200, clip=b).tobytes("png") for b in boxes])
    return out


def kind_of(path: Column, content: Column) -> Column:
    """pdf, docx or text: by suffix, else by the first bytes."""
    low = F.lower(path)
    magic = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    return F.when(low.endswith(".pdf") | magic, "pdf").when(low.endswith(".docx"), "docx").otherwise("text")


def read_documents(spark: SparkSession, path: str, *, glob: str | None = None, reader: ImageReader | None = None, fallback: ImageReader | None = None) -> DataFrame:
    """Files under a path as (path, kind, text, n_pages, error).

    Text is decoded in the JVM, with bytes that are no UTF-8 dropped. Other kinds go
    through Python workers. A file that cannot be read has an error and null text. A
    PDF of pages that are nearly empty is read as images if a reader is given.
    """
    ship(spark)
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (source.option("pathGlobFilter", glob) if glob else source).load(path).select("path", "content").withColumn("kind", kind_of(F.col("path"), F.col("content")))
    plain = files.where("kind = 'text'").select("path", "kind", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"), F.lit(1).alias("n_pages"), F.lit(None).cast("string").alias("error"))
    parsed = files.where("kind <> 'text'").mapInArrow(_parsed(reader, fallback), "path string, kind string, passes array<array<string>>, n_pages int, error string")
    pages = F.transform("passes", merge_lines)
    joined = F.when(F.col("error").isNull(), F.array_join(F.filter(pages, lambda p: p != ""), "\n"))
    return plain.unionByName(parsed.select("path", "kind", joined.alias("text"), "n_pages", "error"))


def _parsed(reader: ImageReader | None, fallback: ImageReader | None):
    def seen(r: ImageReader, png: bytes) -> str:
        try:
            return r.read(png) or ""
        except Exception:  # one crop that fails leaves the others
            return ""

    def passes_of(kind: str, content: bytes) -> tuple[list[list[str]], int]:
        if kind == "docx":
            return [[docx_text(content)]], 1
        pages = pdf_pages(content)
        bare = sum(len("".join(p.split())) for p in pages)
        if reader is None or bare / max(1, len(pages)) >= 20:
            return [[p] for p in pages], len(pages)
        out = []
        for crops in pdf_crops(content):
            texts = [seen(reader, c) for c in crops]
            if fallback is not None and not any(t.strip() for t in texts):
                texts = [seen(fallback, crops[0])]
            out.append(texts)
        return out, len(pages)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, kind in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    passes, n = passes_of(kind, content)
                    rows.append((path, kind, passes, n, None))
                except Exception as e:
                    rows.append((path, kind, [], 0, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["path", "kind", "passes", "n_pages", "error"])

    return mapped


# ------------------------------------------------------------------ pages of job boards

#: Boards by URL, in order: name and pattern whose first group is the job's key.
BOARDS = (("greenhouse", r"greenhouse\.io/([^?#]+)"), ("workday", r"myworkdayjobs\.com/([^?#]+)"), ("amazon", r"amazon\.jobs/[^?#]*?jobs/(\d+)"), ("google", r"google\.com/about/careers/[^?#]*?results/(\d+)"))
SHARED_DOCUMENT = r"docs\.google\.com/document/d/([A-Za-z0-9_-]+)"


def routed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add board and job_key; board is 'page' where none fits."""
    board, key = F.lit("page"), F.lit(None).cast("string")
    for name, pattern in reversed(BOARDS):
        fits = F.col(url).rlike(pattern)
        board, key = F.when(fits, name).otherwise(board), F.when(fits, F.regexp_extract(url, pattern, 1)).otherwise(key)
    return pages.withColumn("board", board).withColumn("job_key", key)


def shared_document_url(url: Column) -> Column:
    """The address at which a shared document is exported as text, or null."""
    key = F.nullif(F.regexp_extract(url, SHARED_DOCUMENT, 1), F.lit(""))
    return F.when(key.isNotNull(), F.concat(F.lit("https://docs.google.com/document/d/"), key, F.lit("/export?format=txt")))


def is_login_page(body: Column) -> Column:
    return F.lower(F.substring(body, 1, 200)).contains("<html")


def posting_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add `text`: the description in a page's job posting data, else the page's text; and how it was got."""
    found = text.posting_description(F.col(html))
    return pages.withColumn("method", F.when(found.isNotNull(), "json-ld").otherwise("html")).withColumn("text", text.html_text(F.coalesce(found, F.col(html))))


def board_posting(board: Column, body: Column) -> Column:
    """The JSON answer of a board's interface as text: title, place, then its parts; null if it is none or has no title.

    Members are looked for in the object that some boards wrap a job in, then at the top.
    """
    v = F.try_parse_json(body)

    def member(*paths: str) -> Column:
        found = [F.nullif(F.try_variant_get(v, f"$.{p}", "string"), F.lit("")) for p in paths]
        return F.coalesce(*found) if len(found) > 1 else found[0]

    def part(label: str, *paths: str) -> Column:
        got = member(*paths)
        return F.when(got.isNotNull(), F.concat(F.lit(f"\n## {label}\n"), text.html_text(got)))

    title = member("title", "jobPostingInfo.title", "job.title")
    head = F.concat(F.lit("# "), title)
    placed = lambda *paths: F.concat(head, F.lit("\n_Location: "), F.coalesce(member(*paths), F.lit("")), F.lit("_\n"))
    plain = lambda *paths: F.concat(F.lit("\n"), text.html_text(F.coalesce(member(*paths), F.lit(""))))
    joined = lambda *parts: F.concat_ws("\n", *parts)
    return (
        F.when(board == "greenhouse", F.concat(placed("location.name"), plain("content")))
        .when(board == "workday", F.concat(placed("jobPostingInfo.location", "location"), plain("jobPostingInfo.jobDescription", "jobDescription")))
        .when(board == "amazon", joined(placed("normalized_location", "location"), part("Description", "description"), part("Basic Qualifications", "basic_qualifications"), part("Preferred Qualifications", "preferred_qualifications")))
        .when(board == "google", joined(F.concat(head, F.lit("\n")), part("Qualifications", "job.qualifications", "qualifications"), part("Responsibilities", "job.responsibilities", "responsibilities"), part("Description", "job.description", "description")))
    )


def board_url(board: Column, url: Column) -> Column:
    """Where a board gives a job in JSON, or null."""
    take = lambda pattern, i: F.regexp_extract(url, pattern, i)
    green, work = r"greenhouse\.io/([^/]+)/jobs/(\d+)", r"^https?://([^/]+)/[^/]+/([^/]+)/job/(.+)$"
    host = take(work, 1)
    return (
        F.when((board == "greenhouse") & url.rlike(green), F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), take(green, 1), F.lit("/jobs/"), take(green, 2), F.lit("?content=true")))
        .when((board == "workday") & url.rlike(work), F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), F.element_at(F.split(host, r"\."), 1), F.lit("/"), take(work, 2), F.lit("/job/"), take(work, 3)))
        .when(board == "amazon", F.concat(F.lit("https://www.amazon.jobs/en/jobs/"), take(r"/jobs/(\d+)", 1), F.lit(".json")))
        .when(board == "google", F.concat(F.lit("https://careers.google.com/api/v3/jobs/"), take(r"results/(\d+)", 1), F.lit("/")))
    )


def read_manifest(spark: SparkSession, path: str, slugs: list[str] | None = None) -> DataFrame:
    """A JSON array of jobs (slug, url, ...) with board and key; only these slugs if given."""
    rows = spark.read.schema("slug string, url string, title string, company string").option("multiLine", True).json(path)
    return routed(rows.where(F.col("slug").isin(*slugs)) if slugs else rows)


def job_texts(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs of a manifest with the text of their stored page (url, html); a job without a page has an error."""
    joined = manifest.join(posting_texts(pages).select("url", "method", "text"), "url", "left")
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    return joined.withColumn("error", F.when(empty, "no page or no text"))
