"""Feeds as whole files: read where they changed, parsed although they are broken, committed with what tells that they are read.

A poll lists the files without their contents, leaves out those that a former poll has read
as they are (path, time and length, the validators of a file), reads the others whole, and
commits entries and validators together.  The parser pulls tags and texts one after the other
out of a file and needs no well-formed XML: an entry ends where the next begins, a field
where the next field of its entry does, an end tag without a start is passed over, and stray
``&`` and ``<`` are text.  RSS, RSS with namespaces and Atom give the same columns.
"""

from __future__ import annotations

import codecs
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import order
from .commits import Tables
from .feeds import ITEM
from .folders import shared_folder

#: What a poll keeps of each file that it has read.
FEED_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modified", T.TimestampType()), T.StructField("length", T.LongType())])

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[?!][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[A-Za-z_][\w.:-]*)(?P<attributes>(?:"[^"<]*"|'[^'<]*'|[^<>"'])*?)(?P<alone>/?)>|(?P<text>[^<]+|<)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([\w.:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*\bencoding\s*=\s*["']([\w.-]+)""")
#: An element's column; several names of one column: the first that stands in the entry.
_COLUMNS = {
    "title": "title", "link": "link", "guid": "guid", "id": "guid", "description": "description", "summary": "summary", "pubDate": "pubDate",
    "published": "published", "issued": "published", "dc:date": "published", "updated": "updated", "modified": "updated",
    "content:encoded": "content:encoded", "content": "content",
}
_ENTRIES = ("item", "entry")
#: Columns that may hold markup, and elements that no markup has, so that they end such a column.
_RICH = ("content", "content:encoded", "description", "summary")
_NO_MARKUP = {t for t in _COLUMNS if t not in ("title", "link", "summary", "content", "description", "id")}
#: Elements of an entry that have titles, links and dates of their own.
_ASIDE = ("source", "author", "contributor", "media:group", "image")
_MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


def decoded(data: bytes) -> str:
    """Text of a file: by its mark, by what it declares, as UTF-8, else as Windows-1252."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    declared = _DECLARED.match(data[:200])
    for name in [declared[1].decode("ascii")] if declared else []:
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def pull(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes or the tag as written) of each tag and text: kinds open, close and text."""
    for m in _TOKEN.finditer(text):
        if m["name"]:
            if m["end"]:
                yield "close", m["name"], m[0]
            else:
                yield "open", m["name"], m["attributes"]
                if m["alone"]:
                    yield "close", m["name"], ""
        elif m["raw"] is not None:
            yield "text", m["raw"], ""
        elif m["text"]:
            yield "text", html.unescape(m["text"]), ""


def _plain(name: str) -> str:
    return name[5:] if name.startswith(("atom:", "rss1:")) else name


def entries(text: str) -> Iterator[dict]:
    """The entries of a feed in their order; columns of :data:`feeds.ITEM`."""
    entry: dict | None = None
    field = tag_open = aside = None
    parts: list[str] = []

    def close_field() -> None:
        nonlocal field, tag_open
        value = "".join(parts).strip()
        if field == "content":
            entry["content"].append(value)
        elif field and value and not entry.get(field):
            entry[field] = value
        field = tag_open = None
        parts.clear()

    for kind, name, more in pull(text):
        tag = _plain(name) if kind != "text" else ""
        if tag in _ENTRIES:
            if entry is not None:
                close_field()
                yield entry
            entry, aside = {"content": []} if kind == "open" else None, None
        elif entry is None:
            continue
        elif aside:
            aside = None if kind == "close" and tag == aside else aside
        elif kind == "open" and tag in _ASIDE and not field:
            aside = tag
        elif kind == "open" and tag in _COLUMNS and (field not in _RICH or tag in _NO_MARKUP):
            close_field()
            tag_open = tag
            attributes = {a: html.unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(more)}
            if tag == "link" and "href" in attributes:
                if attributes.get("rel", "alternate") == "alternate" and not entry.get("link"):
                    entry["link"] = attributes["href"].strip()
            else:
                field = _COLUMNS[tag]
        elif kind == "close" and tag == tag_open:
            close_field()
        elif field:
            # markup inside a field stays markup
            parts.append(name if kind == "text" else f"<{name}{more}>" if kind == "open" else more)
    if entry is not None:
        close_field()
        yield entry


def parse(files: DataFrame) -> DataFrame:
    """Entries of files (path, content): columns of :data:`feeds.ITEM`, file and place (from 1).  A null or empty file has none."""
    names = ITEM.names

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [e | {"file": path, "place": k} for k, e in enumerate(entries(decoded(data or b"")), 1)]
                if rows:
                    columns = [pa.array([r.get(n) for r in rows], pa.list_(pa.string()) if n == "content" else pa.string()) for n in names]
                    columns += [pa.array([r["file"] for r in rows], pa.string()), pa.array([r["place"] for r in rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "file", "place"])

    schema = T.StructType([*ITEM.fields, T.StructField("file", T.StringType()), T.StructField("place", T.LongType())])
    return files.select("path", "content").mapInArrow(run, schema)


def poll(spark: SparkSession, path: str, tables: Tables, log: str, prepare, known: str = "feed_files", pattern: str = "*") -> dict:
    """Reads the files of a folder (and below) that are new or changed, and appends what ``prepare`` makes of their entries to ``log``.

    ``log`` has a column arrival, in which the entries go on counting by file and place.  Gives the
    numbers of files listed and read, and of rows added.  Nothing is committed where nothing changed.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    names = listed.select("path", F.col("modificationTime").alias("modified"), "length")
    with tables.transaction() as t:
        changed = names.join(t.read(known), ["path", "modified", "length"], "left_anti")
        seen, new, since = (names.count(), *changed.agg(F.count("*"), F.min("modified")).first())
        if not new:
            return {"listed": seen, "read": 0, "added": 0}
        # only files from that time on are opened
        whole = listed.filter(F.col("modificationTime") >= F.lit(since)).join(changed.select("path"), "path", "left_semi")
        # written once: dealing out ranges reads its input twice, and files are to be parsed once
        rows = prepare(parse(whole))
        folder = f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        rows = spark.read.schema(rows.schema).parquet(folder)
        before = F.lit(t.read(log).agg(F.max("arrival")).first()[0] or 0)
        rows = order.numbered(rows, F.asc("file"), F.asc("place"), name="arrival").withColumn("arrival", F.col("arrival") + before)
        t.append(log, rows)
        t.append(known, changed)
        t.commit()
        added = spark.read.parquet(*[f"{tables.path}/{d}" for d in t.added[log]]).count()
    return {"listed": seen, "read": new, "added": added}
