"""Tables that come page by page over HTTP: a page is a partition, fetched with retries, and kept once it came."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loomgraph.sources.sinks import shared_dir


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    """Reads lines of pages. A page that fails is asked for again, after a pause that doubles; one that fails every time ends the query."""

    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.pages = [int(p) for p in options["pages"].split(",") if p]
        self.tries, self.pause, self.timeout = int(options.get("tries", 5)), float(options.get("pause", 1.0)), float(options.get("timeout", 60))

    def partitions(self) -> list[Page]:
        return [Page(p) for p in self.pages]

    def _get(self, url: str) -> str:
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:  # noqa: S310
                    return answer.read().decode("utf-8", "replace")
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                gone = isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code not in (408, 429)
                if gone or n == self.tries - 1:
                    raise RuntimeError(f"{url}: {e} in try {n + 1} of {self.tries}") from e
                time.sleep(self.pause * 2**n)
        raise AssertionError("no try was made")

    def read(self, partition: Page) -> Iterator[tuple]:
        for i, line in enumerate(self._get(self.url.replace("{page}", str(partition.number))).splitlines()):
            yield (partition.number, i, line)


class PagedSource(DataSource):
    """``spark.read.format("paged")`` with ``url`` (holding ``{page}``), ``pages`` (numbers, by commas), ``tries``, ``pause`` and ``timeout``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, line int, value string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)


def pages(spark: SparkSession, url: str, numbers: range, folder: str | None = None, together: int = 64, **options: str) -> DataFrame:
    """(page, line, value) of all pages ``numbers`` of ``url``, in which ``{page}`` is the number.

    Pages are kept below ``folder`` (the shared folder by default) under the
    digest of the url, ``together`` at a time; what is there is not asked for
    again, so a query that ended in the middle goes on where it stopped, and an
    empty page counts as one that came. Lines keep their order in ``line``.
    """
    spark.dataSource.register(PagedSource)
    path = f"{folder or shared_dir(spark)}/loom-pages-{hashlib.sha256(url.encode()).hexdigest()[:32]}"
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(sc._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    groups = {f"{g[0]}-{g[-1]}": g for at in range(0, len(numbers), together) if (g := list(numbers[at : at + together]))}
    for name, group in groups.items():
        if not there(name):
            options_ = {"url": url, "pages": ",".join(map(str, group)), **options}
            spark.read.format("paged").options(**options_).load().write.mode("overwrite").parquet(f"{path}/{name}")
    if not groups:
        return spark.createDataFrame([], "page int, line int, value string")
    return spark.read.schema("page int, line int, value string").parquet(*[f"{path}/{name}" for name in groups])


def tsv_pages(paged: DataFrame, delimiter: str = "\t") -> DataFrame:
    """Rows of pages that each begin with the same header: a column a name, as text. The first page's header tells the names."""
    first = paged.where("line = 0").orderBy("page").select("value").first()
    if first is None:
        raise ValueError("no page has a header")
    names = first[0].split(delimiter)
    cells = F.split("value", f"\\Q{delimiter}\\E", -1)
    rows = paged.where("line > 0 and value <> ''")
    return rows.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def json_rows(paged: DataFrame, schema: str, field: str | None = None) -> DataFrame:
    """Rows of pages that are one JSON text each: an array of records, or an object with such an array in ``field``."""
    whole = paged.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text"))
    shape = f"array<struct<{schema}>>" if field is None else f"struct<{field}: array<struct<{schema}>>>"
    parsed = F.from_json("text", shape, {"mode": "FAILFAST"})
    return whole.select(F.inline(parsed if field is None else parsed[field]))
