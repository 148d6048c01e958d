"""Job postings fetched from boards, as a data source whose transport can be swapped."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from fitspark.cluster import ship
from fitspark.functions import text
from fitspark.sources.documents import board_posting, board_url, is_login_page, routed, shared_document_url

#: Jobs of a manifest at most: their addresses are planned on the driver. A larger one is split into several.
MANIFEST_JOBS = 100_000
#: Jobs of one partition.
SLICE = 20
#: Characters that a description in a page's posting data must have more than.
LEAST = 400

FETCHED = "slug string, board string, url string, address string, body string, method string, error string"
FIELDS = ("slug", "board", "url", "address")


class Transport(Protocol):
    """Gets the text at an address, or raises; it must be picklable, as it runs in tasks."""

    def get(self, address: str) -> str: ...


class WebTransport:
    """The network, through the standard library."""

    def __init__(self, timeout: float = 40.0, agent: str = "Mozilla/5.0 (X11; Linux x86_64)") -> None:
        self.timeout, self.agent = timeout, agent

    def get(self, address: str) -> str:
        import urllib.request

        request = urllib.request.Request(address, headers={"User-Agent": self.agent, "Accept": "*/*"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return answer.read().decode("utf-8", errors="ignore")


class StoredTransport:
    """Answers by address, as they were stored; an address without one raises LookupError."""

    def __init__(self, answers: dict[str, str]) -> None:
        self.answers = answers

    def get(self, address: str) -> str:
        if address not in self.answers:
            raise LookupError(f"nothing is stored for {address}")
        return self.answers[address]


class Slice(InputPartition):
    """Some jobs of a manifest."""


class BoardReader(DataSourceReader):
    def __init__(self, jobs: list[dict], transport: Transport, size: int, tries: int, pause: float) -> None:
        self.jobs, self.transport, self.size, self.tries, self.pause = jobs, transport, size, tries, pause

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of slug, board, url and address choose jobs before any is fetched."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.jobs = [j for j in self.jobs if j[f.attribute[0]] in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Slices of the jobs by board, so that a task asks one board as far as it goes. No jobs: one empty slice."""
        jobs = sorted(self.jobs, key=lambda j: (j["board"], j["slug"]))
        return [Slice(jobs[i : i + self.size]) for i in range(0, len(jobs), self.size)] or [Slice([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for j in partition.value:
            yield tuple(j[f] for f in FIELDS) + self.fetched(j)

    def fetched(self, job: dict) -> tuple[str | None, str, str | None]:
        """(body, method, error): the board's own answer if it has an address, else the page; a board that fails leaves the page."""
        error = None
        for method, address in (("board", job["address"]), ("page", job["url"])):
            if not address:
                continue
            for i in range(self.tries):
                try:
                    return self.transport.get(address), method, None
                except Exception as e:  # one job that fails leaves the others
                    error = f"{type(e).__name__}: {str(e)[:200]}"
                    if isinstance(e, LookupError):
                        break
                    if i + 1 < self.tries:
                        time.sleep(self.pause * 2**i)
        return None, "none", error or "no address"


def board_source(transport: Transport) -> type[DataSource]:
    """A data source `job_board` that fetches by this transport."""

    class BoardSource(DataSource):
        """Option `jobs` is a JSON list of {slug, board, url, address}; `slice`, `tries` and `pause` (seconds) are numbers."""

        @classmethod
        def name(cls) -> str:
            return "job_board"

        def schema(self) -> str:
            return FETCHED

        def reader(self, schema) -> DataSourceReader:
            o = self.options
            return BoardReader(json.loads(o["jobs"]), transport, int(o.get("slice", SLICE)), int(o.get("tries", 3)), float(o.get("pause", 0.8)))

    return BoardSource


def fetch(manifest: DataFrame, *, transport: Transport | None = None, size: int = SLICE, tries: int = 3, pause: float = 0.8) -> DataFrame:
    """The jobs of a manifest (slug, url, ...) with what their boards or pages answer:
    slug, board, url, address, body, method, error.

    Shared documents are fetched by their export address. A job that cannot be got has an
    error and null body, and leaves the others. Filters on slug and board are applied
    before anything is fetched. A manifest of more than MANIFEST_JOBS jobs is an
    error; null and repeated slugs are kept. A lost task fetches its slice again.
    """
    spark = manifest.sparkSession
    ship(spark)
    shared = shared_document_url(F.col("url"))
    planned = routed(manifest.where("url is not null")).select("slug", F.when(shared.isNotNull(), "document").otherwise(F.col("board")).alias("board"), "url", F.coalesce(shared, board_url(F.col("board"), F.col("url"))).alias("address"))
    jobs = [r.asDict() for r in planned.limit(MANIFEST_JOBS + 1).collect()]
    if len(jobs) > MANIFEST_JOBS:
        raise ValueError(f"a manifest of more than {MANIFEST_JOBS} jobs: fetch parts of it")
    for j in jobs:
        j["slug"] = j["slug"] if j["slug"] is not None else ""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(board_source(transport or WebTransport()))
    return spark.read.format("job_board").option("jobs", json.dumps(jobs)).option("slice", size).option("tries", tries).option("pause", pause).load()


def texts(fetched: DataFrame) -> DataFrame:
    """Fetched jobs as slug, board, url, method, text, error.

    A board's JSON becomes title, place and parts; a page gives the description in its posting
    data if that is long enough; a shared document is its own text, unless it is a login page.
    What gives no text has an error, and null text.
    """
    body = F.col("body")
    described = text.html_text(text.posting_description(body))
    posting = F.when(F.length(described) > LEAST, described)
    document = F.when(~is_login_page(body), body)
    # What a board answers may be its page, too.
    got = F.when(F.col("board") == "document", document).when(F.col("method") == "board", F.coalesce(board_posting(F.col("board"), body), posting)).otherwise(posting)
    rows = fetched.withColumn("text", F.nullif(got, F.lit("")))
    why = F.when(body.isNull(), F.col("error")).when((F.col("board") == "document") & is_login_page(body), "the document is not shared with everyone who has its address").otherwise("no posting found")
    return rows.select("slug", "board", "url", "method", "text", F.when(F.col("text").isNull(), why).alias("error"))


def markdown(rows: DataFrame, *, role: Column, org: Column) -> DataFrame:
    """Add `markdown`: a head with role, organisation and address above the text; null without one."""
    head = F.concat(F.lit("# "), F.coalesce(role, F.lit("")), F.lit(" — "), F.coalesce(org, F.lit("")), F.lit("\nSource: "), F.col("url"), F.lit("\n\n"))
    return rows.withColumn("markdown", F.concat(head, F.col("text")))
