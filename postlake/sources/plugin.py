"""What SQL and readers can name: payload folders as a data source, feed parsing as a table function, and the similarity of texts."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import StringType, StructField, StructType

from postlake.operators import dedup
from postlake.sources import feeds

PAYLOADS = "source string, file string, payload string"


class _File(InputPartition):
    def __init__(self, source: str, path: str):
        self.source, self.path = source, path


class _PayloadReader(DataSourceReader):
    """A partition a file; conditions on the source leave out files before any is opened."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file:")
        self.sources: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("source",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sources = wanted if self.sources is None else self.sources & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = []
        for folder in sorted(os.listdir(self.path)):
            name, _, source = folder.partition("=")
            if name == "source" and (self.sources is None or source in self.sources):
                found += [_File(source, f"{self.path}/{folder}/{x}") for x in sorted(os.listdir(f"{self.path}/{folder}")) if x[0] not in "._"]
        return found

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                yield partition.source, os.path.basename(partition.path), line.rstrip("\n")


class PayloadSource(DataSource):
    """Raw payloads under ``path``, a folder that all executors see: a folder source=NAME each, with a payload a line."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return PAYLOADS

    def reader(self, schema) -> DataSourceReader:
        return _PayloadReader(self.options)


def _at(value, path: str):
    """What a path like $.a.b names, or None."""
    for step in path.split(".")[1:]:
        value = value.get(step) if isinstance(value, dict) else None
    return value


_ITEM = ("external_id", "title", "company", "location", "url")


@udtf(returnType=StructType([StructField(x, StringType()) for x in _ITEM]))
class FeedItems:
    """The items of a JSON payload by a feed of the registry; items without a title, and what is no JSON, give none."""

    def eval(self, payload: str, feed: str):
        spec = feeds.FEEDS[feed]
        try:
            items = _at(json.loads(payload or ""), spec.items)
        except ValueError:
            return
        for item in items if isinstance(items, list) else []:
            row = []
            for name in _ITEM:
                found = (_at(item, p) for p in spec.fields.get(name, ()))
                plain = (str(x).strip() for x in found if x is not None and not isinstance(x, (dict, list)))
                row.append(next((x for x in plain if x), spec.defaults.get(name, "")))
            if row[1]:
                yield tuple(row)


def _ratio(one):
    words = lambda t: " ".join(sorted((t or "").split()))

    @pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(words(x), words(y)) for x, y in zip(a, b, strict=True)])

    return ratio


def register(spark: SparkSession) -> None:
    """Make known: format `payloads`, table function `feed_items`, and `token_sort_ratio` and `token_set_jaccard`, 0 to 100."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
    spark.udtf.register("feed_items", FeedItems)
    spark.udf.register("token_sort_ratio", _ratio(dedup._indel))
    spark.udf.register("token_set_jaccard", _ratio(dedup._jaccard))
