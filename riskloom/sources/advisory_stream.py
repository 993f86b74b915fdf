"""Advisories of a REST service as a data source: format "advisories", for batches and for streams.

    spark.dataSource.register(AdvisorySource)
    spark.read.format("advisories").option("url", url).load()
    spark.readStream.format("advisories").option("url", url).load()

Options: url, key, per_minute (requests, 5), size (advisories of a page, 100), keyword, product, cwe, since (only what was
modified then or later). The service answers a page of startIndex and resultsPerPage, the first modified first.

As the service allows few requests, all of a query come from one reader, which waits between them. A stream takes a page a
batch. Its offset is the time of the last change that it has read and how many of that very time, so what changes while
it reads moves to the end and is read again there, and nothing before it shifts.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from riskloom.sources.advisories import SCHEMA, Service

FIRST = "1970-01-01T00:00:00"


def _time(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat((text or "")[:19])
    except ValueError:
        return None


def _row(cve: dict) -> tuple:
    """An advisory in the order of SCHEMA; parts that are missing are null or empty."""
    metrics = cve.get("metrics") or {}
    found = next((m[0]["cvssData"] for m in (metrics.get("cvssMetricV31"), metrics.get("cvssMetricV30")) if m), {})
    said = next((d.get("value") for d in cve.get("descriptions") or [] if d.get("lang") == "en"), "")
    cwes = [d["value"] for w in cve.get("weaknesses") or [] for d in w.get("description") or [] if str(d.get("value", "")).startswith("CWE-")]
    products = [m["criteria"] for c in cve.get("configurations") or [] for n in c.get("nodes") or [] for m in n.get("cpeMatch") or [] if m.get("criteria")]
    urls = [r["url"] for r in cve.get("references") or [] if r.get("url")]
    return (cve.get("id"), said, float(found.get("baseScore", 0.0)), found.get("vectorString", ""), found.get("baseSeverity", "UNKNOWN"), cwes, products, urls, _time(cve.get("published")), _time(cve.get("lastModified")))


class Pages:
    """Asks for pages; a request that fails is made again, and ends the query if it fails for good."""

    def __init__(self, options: dict, tries: int = 3):
        self.size, self.tries = int(options.get("size", 100)), tries
        self.service = Service(options["url"], options.get("key"), int(options.get("per_minute", 5)), keep=0)
        self.asked = {k: options.get(k) for k in ("keyword", "product", "cwe")}

    def page(self, since: str, start: int, size: int | None = None) -> tuple[list[dict], int]:
        """Advisories from a place on among those modified ``since`` or later, and how many there are in all."""
        for left in range(self.tries - 1, -1, -1):
            text = self.service.search(keyword=self.asked["keyword"], product=self.asked["product"], cwe_id=self.asked["cwe"], start=start, size=size or self.size, since=since)
            if text is not None:
                answer = json.loads(text)
                return [v["cve"] for v in answer.get("vulnerabilities", [])], int(answer.get("totalResults", 0))
            if left:
                time.sleep(self.service.pause)
        raise OSError(f"no answer from {self.service.url}")


class BatchReader(DataSourceReader):
    """All pages in turn, in one task."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pages, start = Pages(self.options), 0
        while True:
            found, total = pages.page(self.options.get("since", FIRST), start)
            yield from map(_row, found)
            start += len(found)
            if not found or start >= total:
                return


class StreamReader(SimpleDataSourceStreamReader):
    """A page a batch, from where the last one ended."""

    def __init__(self, options: dict):
        self.options, self.pages = options, Pages(options)

    def initialOffset(self) -> dict:
        return {"modified": self.options.get("since", FIRST), "read": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found, _ = self.pages.page(start["modified"], start["read"])
        return iter([_row(x) for x in found]), self._after(start, found)

    def _after(self, start: dict, found: list[dict]) -> dict:
        if not found:
            return start
        last = found[-1].get("lastModified") or start["modified"]
        same = sum(x.get("lastModified") == last for x in found)
        return {"modified": last, "read": same + (start["read"] if last == start["modified"] else 0)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch again, after a restart: what was modified up to its end; what has changed since comes later."""
        at, rows = start, []
        while (at["modified"], at["read"]) < (end["modified"], end["read"]):
            found, _ = self.pages.page(at["modified"], at["read"])
            if not found:
                break
            for x in found:
                at = self._after(at, [x])
                if (at["modified"], at["read"]) > (end["modified"], end["read"]):
                    return iter(rows)
                rows.append(_row(x))
        return iter(rows)


class AdvisorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "advisories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return StreamReader(dict(self.options))
