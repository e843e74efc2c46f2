"""A paged JSON interface as a data source: one partition for each search term."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class TermPartition(InputPartition):
    def __init__(self, term: str, limit: int):
        super().__init__(term)
        self.term, self.limit = term, limit


class PagedReader(DataSourceReader):
    """Reads pages until one is empty, short or without a token, or the limit is reached."""

    def __init__(self, options):
        self.terms = json.loads(options["terms"])
        self.field = options.get("field", "query.term")
        self.page_size = max(1, min(int(options.get("pageSize", "100")), 100))
        self.pause = float(options.get("pause", "0"))
        most = int(options.get("maxRecords", "1000"))
        self.limit = -(-most // max(1, len(self.terms)))
        self.pages = json.loads(options["pages"]) if "pages" in options else None
        self.url = options.get("url", "")

    def partitions(self):
        return [TermPartition(t, self.limit) for t in self.terms]

    def fetch(self, term: str, size: int, token: str | None) -> dict:
        """One page: canned ones by term and token, else over the network."""
        if self.pages is not None:
            return self.pages.get(f"{term}/{token or ''}", {})
        from urllib.parse import urlencode
        from urllib.request import urlopen

        query = {self.field: term, "format": "json", "pageSize": size} | ({"pageToken": token} if token else {})
        with urlopen(f"{self.url}?{urlencode(query)}", timeout=60) as answer:
            return json.loads(answer.read())

    def read(self, partition: TermPartition) -> Iterator[tuple[str, int, str]]:
        token, seen = None, 0
        while seen < partition.limit:
            size = min(self.page_size, partition.limit - seen)
            page = self.fetch(partition.term, size, token)
            found = page.get("studies")
            studies = found[:size] if isinstance(found, list) else []
            for s in studies:
                yield partition.term, seen, json.dumps(s, sort_keys=True)
                seen += 1
            token = page.get("nextPageToken")
            if not token or len(studies) < size:
                return
            time.sleep(self.pause)


class PagedSource(DataSource):
    """``spark.read.format("paged_json")``; options: terms (JSON list), field, maxRecords, pageSize (1 to 100), pause (seconds between pages), url, or pages (canned, JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "search_term string, seq int, payload string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
