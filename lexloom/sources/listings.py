"""A listing source for posts and comments: keyset pagination, retries with backoff, date window.

The transport is a callable, so the reader runs against recorded pages where there is no network.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fetch = Callable[[str, int | None, int], list[dict[str, Any]]]
POST = "post_id string, body string, createdAt timestamp_ntz, subreddit string, type string, comment_id string, parent_id string, source string"


class Unavailable(Exception):
    """A rate limit or a server error; worth another try."""


def with_retries(call: Callable[[], Any], tries: int = 5, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Waits ``base * 2 ** k`` and up to as much again before try ``k + 1``."""
    for k in range(tries):
        try:
            return call()
        except Unavailable:
            if k == tries - 1:
                raise
            sleep(base * 2**k * (1 + random.random()))


def pages(fetch: Fetch, listing: str, start: int, end: int, page: int = 100, most_pages: int = 1000, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict[str, Any]]:
    """Records of a listing in ``[start, end]`` from the newest back; each page begins before the oldest seen. More than ``most_pages`` is an error."""
    before: int | None = end + 1
    seen: set[str] = set()
    for _ in range(most_pages):
        got = with_retries(lambda before=before: fetch(listing, before, page), sleep=sleep)
        new = [r for r in got if r["id"] not in seen]
        if not new:
            return
        for r in new:
            seen.add(r["id"])
            if start <= r["created_utc"] <= end:
                yield r
        before = min(r["created_utc"] for r in got)
        if before < start or len(got) < page:
            return
    raise RuntimeError(f"{listing} has more than {most_pages} pages in the window; nothing before {before} was read")


def record(r: dict[str, Any], source: str) -> tuple:
    """A post's title and text, or a comment's body, in the columns of ``POST``."""
    import pandas as pd

    comment = "body" in r
    body = r["body"] if comment else f"{r.get('title', '')} {r.get('selftext') or ''}".strip()
    return (r.get("link_id", r["id"]), body, pd.Timestamp(r["created_utc"], unit="s"), r.get("subreddit"), "comment" if comment else "post", r["id"] if comment else None, r.get("parent_id"), source)


def _read(rows: DataFrame, each: Callable[..., Iterator[dict[str, Any]]]) -> DataFrame:
    """A task per row of ``rows``, whose values are the arguments of ``each``; of each id the first by source stays."""
    names = [c.split()[0] for c in POST.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for args in pdf.itertuples(index=False, name=None):
                yield pd.DataFrame([record(r, ":".join(map(str, args))) for r in each(*args)], columns=names)

    got = rows.mapInPandas(run, POST)
    first = got.groupBy(F.coalesce("comment_id", "post_id").alias("_id")).agg(F.min_by(F.struct(*names), "source").alias("_r"))
    return first.select("_r.*")


def read_listings(spark: SparkSession, listings: list[str], fetch: Fetch, start: int, end: int) -> DataFrame:
    """One task per listing; posts become title and text, comments their body; first of each id stays."""
    names = spark.createDataFrame([(x,) for x in listings], "listing string").repartition(max(1, len(listings)), "listing")
    return _read(names, lambda name: pages(fetch, name, start, end))


def read_searches(spark: SparkSession, queries: list[str], sorts: list[str], fetch: Callable[[str, str], list[dict[str, Any]]], start: int, end: int) -> DataFrame:
    """One task for each query and sort; ``fetch(query, sort)`` gives what a search finds, of which the window ``[start, end]`` stays."""
    asked = spark.createDataFrame([(q, s) for q in queries for s in sorts], "query string, sort string").repartition(max(1, len(queries) * len(sorts)), "query", "sort")
    return _read(asked, lambda q, s: (r for r in with_retries(lambda: fetch(q, s)) if start <= r["created_utc"] <= end))


def read_comments(posts: DataFrame, fetch: Callable[[str, int], list[dict[str, Any]]], start: int, end: int, most: int = 50) -> DataFrame:
    """Comments of the posts in ``posts`` (``post_id``), of each the first ``most`` that its listing gives, in the window ``[start, end]``."""
    return _read(posts.select("post_id").where("post_id is not null").distinct(), lambda i: (r for r in with_retries(lambda: fetch(i, most))[:most] if start <= r["created_utc"] <= end))
