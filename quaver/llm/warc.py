"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives two records that refer to it. The metadata record lists the
response's source headers and what is found in the page (title, language, and how many
links it has, not their targets); the conversion record holds the page's plain text.
Both keep the response's own record id (WARC-Refers-To), target URI, date, headers and
payload digest as they are in the input; each has an id and a block digest of its own.
A response that comes without an id or a digest gets one derived from its contents, as
the new records do, so a second run gives the same records.

Rows are converted where they are: no shuffle, and no task holds more than its rows.

Edge cases: a null or empty page gives a conversion record with an empty block; a null
URL leaves the target out; a null or empty id, digest or header block counts as not
given. A very long page is converted whole. Repeated rows give repeated records with
equal ids. An empty table gives an empty one. Extra columns are not read, whatever they
are called. Character references in text and title are read once, whatever their number; one
that is no number and no HTML name stays as it is, a number that is no character gives U+FFFD.

``write`` makes .warc.gz files of the records, one for each task that has some, with a gzip
member for each record, so that readers may start at any of them.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator
from html.entities import html5

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from ..sources.song_files import SongFilesWriter, Written, opened

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z))"
_BLOCK = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|main|aside|nav|header|footer|title|head|body|blockquote|pre|form)\b[^>]*>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a variable that holds the value: inside lambdas Spark computes a repeated expression each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digest(text: Column) -> Column:
    """``sha1:`` and the base 32 form of the SHA-1 of the UTF-8 bytes."""
    letter = lambda n: F.substring(F.lit(BASE32), n.cast("int") + 1, F.lit(1))
    four = lambda n: F.concat(letter(F.shiftright(n, 15)), letter(F.shiftright(n, 10) % 32), letter(F.shiftright(n, 5) % 32), letter(n % 32))
    groups = lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(h, g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    return F.concat(F.lit("sha1:"), _bound(F.sha1(text.cast("binary")), lambda h: F.array_join(F.transform(groups(h), four), "")))


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12), F.lit(">"))


def named_characters() -> dict[str, str]:
    """The characters of the HTML names that end in a semicolon, the common ones first; a no-break space is a space here."""
    first = ("nbsp", "amp", "lt", "gt", "quot", "apos")
    names = [f"{n};" for n in first] + sorted((n for n in html5 if n.endswith(";") and n[:-1] not in first), key=lambda n: (len(n), n))
    return {n[:-1]: " " if n == "nbsp;" else html5[n] for n in names}


def renumbered() -> dict[int, str]:
    """Numbers that stand for another character: 128 to 159 are Windows-1252 in pages, 160 a space here."""
    found = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    return {n: c for n, c in found.items() if c} | {160: " "}


def _constant(table: dict, kind: str) -> Column:
    """A map as one literal of the plan."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in table.items()})), f"map<string,{kind}>")


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number; what is no character gives U+FFFD."""
    renamed = _constant(renumbered(), "string")

    def char(n: Column) -> Column:
        legal = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(legal, F.coalesce(F.when(n.between(128, 160), F.try_element_at(renamed, n.cast("string"))), own)).otherwise(F.lit("\ufffd"))

    number = lambda short: F.when(F.length(short).between(1, 7), F.conv(short, base, 10).cast("long"))
    return _bound(F.regexp_replace(digits, "^0+", ""), lambda short: _bound(number(short), char))


def entities(t: Column) -> Column:
    """The text with the characters that its references stand for: all numbers, and all HTML names that end in a semicolon. Each is read once, so ``&amp;lt;`` is ``&lt;``."""
    names = _constant(named_characters(), "string")

    def char(ref: Column) -> Column:
        bare = F.rtrim(ref, F.lit(";"))
        return (
            F.when(ref == "", F.lit(None).cast("string"))
            .when(ref.rlike("^#[xX]"), _numbered(F.substr(bare, F.lit(3)), 16))
            .when(ref.startswith("#"), _numbered(F.substr(bare, F.lit(2)), 10))
            .otherwise(F.try_element_at(names, bare))
        )

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;)", 1)
        return _bound(ref, lambda ref: F.coalesce(F.concat(char(ref), F.substr(part, F.length(ref) + 1)), F.concat(F.lit("&"), part)))

    read = F.array_join(F.transform(F.split(t, "&", -1), lambda part, i: F.when(i == 0, part).otherwise(one(part))), "")
    return F.when(F.contains(t, F.lit("&")), read).otherwise(t)


def without_tags(html: Column) -> Column:
    """A page without scripts, styles, comments and tags; a line for each block."""
    t = F.regexp_replace(html, _HIDDEN, " ")
    return F.regexp_replace(F.regexp_replace(t, _BLOCK, "\n"), r"<[^<>]*>", "")


def spaced(t: Column) -> Column:
    """A text with single spaces and lines, and none at its ends."""
    # what is one space or one line already is not matched: a match costs far more than a step
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")
    return F.btrim(F.regexp_replace(t, r" \n[ \n]*|\n[ \n]+", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags, references read; a line for each block."""
    return spaced(entities(without_tags(html)))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """``Name: value`` lines; a null value leaves its line out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in pairs))


def derive(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    headers: str | None = None,
    date: Column | None = None,
    record: str | None = None,
    payload: str | None = None,
) -> DataFrame:
    """Two rows for each response.

    (page_id, record_type, record_id, refers_to, target_uri, date, source_headers, payload_digest, block_digest, content_type, content_length, block)

    ``headers``, ``record`` and ``payload`` name the columns of the response's header block, record id and payload digest.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    some = lambda c: F.when(c != "", c)
    given = lambda name, own: F.coalesce(some(F.col(name)), own) if name else own
    plain = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("target_uri"), (date if date is not None else F.lit(DATE)).alias("date"),
        given(headers, plain).alias("source_headers"), page.alias("__html"), given(payload, digest(page)).alias("payload_digest"),
        (F.col(record) if record else F.lit(None).cast("string")).alias("__id"),
    )
    rows = rows.withColumn("refers_to", given("__id", record_id(F.lit("response"), F.col("page_id"), F.col("target_uri"), F.col("payload_digest"))))
    # a column for what is used more than once, so that it is found once a row
    named = F.regexp_extract("__html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    lang = F.lower(F.regexp_extract("__html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1))
    rows = rows.withColumns({"__bare": without_tags(F.col("__html")), "__named": named, "__lang": lang})
    rows = rows.withColumns({"__text": spaced(entities(F.col("__bare"))), "__title": F.trim(F.regexp_replace(entities(F.col("__named")), r"\s+", " "))})
    title, lang = F.col("__title"), F.col("__lang")
    links = F.regexp_count("__html", F.lit(r"(?i)<a\b[^>]*\bhref")).cast("string")
    found = _fields(("title", some(title)), ("language", some(lang)), ("outlinks", links), ("text-length", F.octet_length("__text").cast("string")))
    about = F.concat(found, F.regexp_replace("source_headers", r"(?m)^(?=[^\r\n])", "http-header-"), F.lit("\r\n"))
    one = lambda kind, content, block: F.struct(F.lit(kind).alias("record_type"), F.lit(content).alias("content_type"), block.alias("block"))
    both = F.array(one("metadata", "application/warc-fields", about), one("conversion", "text/plain; charset=utf-8", F.col("__text")))
    kept = ("page_id", "target_uri", "date", "source_headers", "payload_digest", "refers_to")
    rows = rows.select(*kept, F.explode(both).alias("r")).select(*kept, "r.*").withColumn("block_digest", digest(F.col("block")))
    rows = rows.withColumn("record_id", record_id(F.col("record_type"), F.col("refers_to"), F.col("block_digest"))).withColumn("content_length", F.octet_length("block"))
    return rows.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "source_headers", "payload_digest", "block_digest", "content_type", "content_length", "block"
    )


def record_text() -> Column:
    """A derived row as the text of a WARC record, ready to be written one after the other."""
    head = _fields(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    )
    return F.concat(F.lit(VERSION + "\r\n"), head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"))


class WarcFilesWriter(SongFilesWriter):
    """A task's records as one file, staged and moved into place when all tasks are done."""

    def write(self, iterator: Iterator) -> Written:
        context = TaskContext.get()
        attempt = str(context.taskAttemptId())
        where, stage = opened(self.stage)
        first = next(iterator, None)
        if first is None:
            return Written(attempt, 0)
        where.create_dir(f"{stage}/{attempt}", recursive=True)
        job = self.stage.rpartition("-")[2]
        with where.open_output_stream(f"{stage}/{attempt}/part-{context.partitionId():05d}-{job}.warc.gz", compression=None) as out:
            out.write(self.member(first))
            for r in iterator:
                out.write(self.member(r))
        return Written(attempt, 1)

    @staticmethod
    def member(row) -> bytes:
        return gzip.compress(row["record"].encode(), mtime=0)


class WarcFiles(DataSource):
    """``df.write.format("warcfiles")`` of (record), as ``write`` makes it."""

    @classmethod
    def name(cls) -> str:
        return "warcfiles"

    def schema(self) -> str:
        return "record string"

    def writer(self, schema: StructType, overwrite: bool) -> WarcFilesWriter:
        return WarcFilesWriter(self.options["path"], "warc", [], overwrite)


def write(derived: DataFrame, path: str, overwrite: bool = False) -> None:
    """The records of ``derive`` as .warc.gz files in a folder that executors and driver share; added to those that are there, or in their place.

    Nothing is shuffled. A failed job leaves the folder as it was; rows without a record id or a block are no records and are left out.
    """
    derived.sparkSession.dataSource.register(WarcFiles)
    records = derived.select(record_text().alias("record")).where("record is not null")
    records.write.format("warcfiles").option("path", path).mode("overwrite" if overwrite else "append").save()
