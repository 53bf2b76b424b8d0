"""Fetched payloads as Spark data sources: folders of pages to read, batch or stream, and a write-once archive to write.

``register`` makes every connector a format of the session, so the lookup of a connector is ``spark.read.format(key)`` and an unknown
one is Spark's own error.  A folder holds one file for each page (``page-00001``); a page is a partition, filters on ``page`` leave
out partitions, and a stream's offset is the number of pages read.  Files are reached by the folder's own scheme, from the executors.

The archive stores bytes under their hash: an object that is there is never written again, a payload that carries a credential is
refused, and a commit says how many were written, kept and refused.  Objects come back as ``binaryFile`` rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from clausewise.constants import CREDENTIAL_PARAMS

PAGE_SIZE, MAX_PAGES = 100, 20
_PAGE = re.compile(r"page-(\d+)$")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    system, inside = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system, inside.rstrip("/")


def _pages(path: str) -> list[int]:
    system, inside = _opened(path)
    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    return sorted(int(m[1]) for f in found if (m := _PAGE.search(f.path)))


def _read(path: str, page: int) -> bytes:
    system, inside = _opened(path)
    with system.open_input_stream(f"{inside}/page-{page:05d}") as f:
        return f.read()


# ---------------------------------------------------------------- profiles


def _value(element: ET.Element, *names: str) -> str | None:
    """The first of the child elements that has a text."""
    texts = ((element.findtext(n) or "").strip() for n in names)
    return next((t for t in texts if t), None)


def _rules(body: bytes) -> list[tuple]:
    """Entries of a rule index; one without number or title is none."""
    each = ((_value(e, "행정규칙ID", "행정규칙일련번호"), _value(e, "행정규칙명"), _value(e, "행정규칙종류"), _value(e, "발령일자"), _value(e, "시행일자")) for e in ET.fromstring(body).iter("admrul"))
    return [x for x in each if x[0] and x[1]]


def _items(body: bytes) -> list[tuple]:
    return [(_value(e, "title"), _value(e, "link"), _value(e, "pubDate")) for e in ET.fromstring(body).iter("item")]


def _whole(body: bytes) -> list[tuple]:
    return [(body.decode("utf-8", "replace"),)]


#: Format name: columns behind the page's, and what turns a page's bytes into rows.
PROFILES = {
    "law": ("body string", _whole), "admrul": ("body string", _whole), "listing": ("body string", _whole), "recognition_list": ("body string", _whole),
    "rss": ("title string, link string, published string", _items),
    "admrul_index": ("admrul_id string, title string, kind string, promulgated_on string, effective_on string", _rules),
}


@dataclass
class _Page(InputPartition):
    number: int


class _Rows:
    """Rows of single pages; a page that is not what the profile expects is one row with a reason and nothing else."""

    def __init__(self, key: str, options: dict):
        columns, self.parse = PROFILES[key]
        self.path, self.width = options["path"], len(columns.split(","))
        self.size, self.cap = int(options.get("page_size", PAGE_SIZE)), int(options.get("max_pages", 0))

    def rows(self, number: int) -> Iterator[tuple]:
        try:
            found = self.parse(_read(self.path, number))
        except ET.ParseError as e:
            yield (number, 0, False, *([None] * self.width), f"unreadable: {e}")
            return
        for k, row in enumerate(found):
            yield (number, k, len(found) >= self.size, *row, None)

    def numbers(self) -> list[int]:
        found = _pages(self.path)
        return found[: self.cap] if self.cap else found


_HOLDS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class _Reader(DataSourceReader):
    def __init__(self, source: _Rows):
        self.source, self.wanted = source, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _HOLDS and f.attribute == ("page",):
                self.wanted.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[_Page]:
        return [_Page(n) for n in self.source.numbers() if all(_HOLDS[kind](n, value) for kind, value in self.wanted)]

    def read(self, partition: _Page | None) -> Iterator[tuple]:
        # without any page Spark still asks once
        return self.source.rows(partition.number) if partition else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, source: _Rows):
        self.source = source

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": max(self.source.numbers(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return [_Page(n) for n in self.source.numbers() if start["pages"] < n <= end["pages"]]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return self.source.rows(partition.number)


def _format(key: str) -> type[DataSource]:
    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return key

        def schema(self) -> str:
            return f"page int, position int, full boolean, {PROFILES[key][0]}, error string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(_Rows(key, self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(_Rows(key, self.options))

    return Pages


# ---------------------------------------------------------------- archive


def object_path(digest: str) -> str:
    return f"sha256/{digest[:2]}/{digest}"


@dataclass
class Written(WriterCommitMessage):
    written: int
    kept: int
    refused: int


class _ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.run = options["path"], uuid.uuid4().hex
        self.secret = re.compile(rf"[?&](?:{'|'.join(CREDENTIAL_PARAMS)})=[^&\s{{]".encode())
        self.known = [c.encode() for c in options.get("credentials", "").split(",") if c]

    def write(self, iterator: Iterator) -> Written:
        system, inside = _opened(self.path)
        counts = {"written": 0, "kept": 0, "refused": 0}
        for row in iterator:
            body = bytes(row["body"])
            if self.secret.search(body) or any(c in body for c in self.known):
                counts["refused"] += 1
                continue
            target = f"{inside}/{object_path(hashlib.sha256(body).hexdigest())}"
            if system.get_file_info(target).type != fs.FileType.NotFound:
                counts["kept"] += 1
                continue
            # whole files only appear under their names: they are written beside them and moved
            held = f"{inside}/_pending/{self.run}-{uuid.uuid4().hex}"
            for folder in (held, target):
                system.create_dir(folder.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(held) as f:
                f.write(body)
            system.move(held, target)
            counts["written"] += 1
        return Written(**counts)

    def commit(self, messages: list) -> None:
        system, inside = _opened(self.path)
        total = {c: sum(getattr(m, c) for m in messages if m) for c in ("written", "kept", "refused")}
        system.create_dir(f"{inside}/_commits", recursive=True)
        with system.open_output_stream(f"{inside}/_commits/{self.run}") as f:
            f.write(json.dumps(total).encode())

    def abort(self, messages: list) -> None:
        """Objects under their hashes are what they are named, and stay; what was not finished goes."""
        system, inside = _opened(self.path)
        for f in system.get_file_info(fs.FileSelector(f"{inside}/_pending", allow_not_found=True)):
            if f.base_name.startswith(self.run):
                system.delete_file(f.path)


class Archive(DataSource):
    """``df.write.format("write_once").option("path", folder).mode("append")``; rows have a column body (binary)."""

    @classmethod
    def name(cls) -> str:
        return "write_once"

    def schema(self) -> str:
        return "body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a write-once archive is only appended to")
        return _ArchiveWriter(self.options)


class _PageWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, inside = _opened(self.path)
        system.create_dir(inside, recursive=True)
        for row in iterator:
            with system.open_output_stream(f"{inside}/page-{row['page']:05d}") as f:
                f.write(bytes(row["body"]))
        return WriterCommitMessage()


class Pages(DataSource):
    """Writes rows (page int, body binary) as the page files that the connectors read."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PageWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """All connectors and the archive as formats of the session; filters on pages reach the readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (*map(_format, PROFILES), Archive, Pages):
        spark.dataSource.register(source)


def archive(payloads: DataFrame, folder: str, credentials: tuple[str, ...] = ()) -> None:
    """Write the bodies of ``payloads`` (body) that are not in the archive yet."""
    register(payloads.sparkSession)
    rows = payloads.where("body IS NOT NULL").select(F.col("body").cast("binary").alias("body")).withColumn("key", F.sha2("body", 256))
    # equal payloads meet before they are written, so no two tasks write one object
    rows.dropDuplicates(["key"]).select("body").write.format("write_once").option("path", folder).option("credentials", ",".join(credentials)).mode("append").save()


def archived_objects(spark: SparkSession, folder: str) -> DataFrame:
    """object_key, digest, raw_bytes, body of all objects, read back as bytes; ``sound`` says whether a name is its content's hash.

    The object of an empty payload is there, but Spark's reader of binary files passes over empty files.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder.rstrip('/')}/sha256")
    digest = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), digest).alias("object_key"), digest.alias("digest"), F.col("length").alias("raw_bytes"), F.col("content").alias("body"), (F.sha2("content", 256) == digest).alias("sound"))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """run, written, kept, refused of each commit."""
    rows = spark.read.text(f"{folder.rstrip('/')}/_commits", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("run"), F.from_json("value", "written long, kept long, refused long").alias("c"))
    return rows.select("run", "c.*")


def index_walk(pages: DataFrame, cap: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """(entries, truncated) of an index's rows: a walk ends at the first page that is not full, or at the cap, which says nothing of what lies behind."""
    seen = pages.where(F.col("page") <= cap)
    short = seen.where(~F.col("full")).agg(F.min("page").alias("last"))
    entries = seen.join(F.broadcast(short), F.coalesce(F.col("page") <= F.col("last"), F.lit(True))).drop("last")
    return entries, seen.agg(F.max("page").alias("pages")).join(short, how="left", on=F.lit(True)).select((F.col("last").isNull() & (F.col("pages") >= cap)).alias("truncated"))
