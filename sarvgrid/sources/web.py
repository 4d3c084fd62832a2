"""Pages and encyclopedia extracts fetched over HTTP by executors, with bounded retries.

Fetching is a function of rows: a table of addresses is dealt out, each task fetches its own, and a failure is a row that says so.
Without a network, tables of pages stand in for it.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "url string, html string, error string"
EXTRACT = "page_id long, page_title string, source_url string, revision_id string, text string"
#: HTTP statuses after which it is worth another try.
AGAIN = (429, 503)
TITLES = 20


def get(url: str, retries: int = 4, pause: float = 2.0, timeout: float = 30.0, agent: str = "corpus-sampling/1.0") -> str:
    """A page as text by the character set of its header; what can't be decoded is replaced. Waits longer before each retry."""
    for attempt in range(retries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:  # noqa: S310
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.URLError as e:
            final = isinstance(e, urllib.error.HTTPError) and e.code not in AGAIN
            if final or attempt == retries - 1:
                raise
            time.sleep(pause * (attempt + 1))
    raise ValueError("retries must be positive")


def pages(urls: DataFrame, fetch: Callable[[str], str] = get) -> DataFrame:
    """url, html, error of each row of ``urls`` (url); one of the two last is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, fetch(url), None))
                except (urllib.error.URLError, TimeoutError, ValueError) as e:
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, PAGE)


def extracts(titles: DataFrame, api: str, fetch: Callable[[str], str] = get, batch: int = TITLES) -> DataFrame:
    """Introductions of encyclopedia articles (title) as plain text, ``batch`` titles a request to the API; missing articles have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for a in range(0, len(part), batch):
                asked = {"action": "query", "prop": "extracts|info|revisions", "explaintext": 1, "exintro": 1, "rvprop": "ids", "inprop": "url", "titles": "|".join(part["title"].iloc[a : a + batch]), "format": "json"}
                found = json.loads(fetch(f"{api}?{urllib.parse.urlencode(asked)}")).get("query", {}).get("pages", {})
                rows = [(int(p["pageid"]), p.get("title", ""), p.get("fullurl", ""), str((p.get("revisions") or [{}])[0].get("revid", "")), p["extract"]) for p in found.values() if "extract" in p and "missing" not in p]
                yield pd.DataFrame(rows, columns=["page_id", "page_title", "source_url", "revision_id", "text"])

    return titles.select("title").mapInPandas(run, EXTRACT)


def random_titles(api: str, fetch: Callable[[str], str] = get, n: int = TITLES) -> list[str]:
    """``n`` titles the API picks, at the driver."""
    asked = urllib.parse.urlencode({"action": "query", "list": "random", "rnnamespace": 0, "rnlimit": n, "format": "json"})
    return [x["title"] for x in json.loads(fetch(f"{api}?{asked}")).get("query", {}).get("random", [])]


def failed(fetched: DataFrame) -> DataFrame:
    return fetched.where(F.col("error").isNotNull())
