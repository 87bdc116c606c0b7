"""Sinks: tables, CSV, JSON and leadsheets, as text for one song, or as files or lines for all."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import music as M
from ..operators import leadsheet

FORMATS = ("table", "csv", "json", "leadsheet")
FIRST = ("note", "start_time", "end_time", "confidence", "lyric")
HIDDEN = ("song_id", "event_idx", "midi")


def public_columns(events: DataFrame) -> list[str]:
    """Columns in the order of output: the known ones first, then the others as they come."""
    shown = [c for c in events.columns if c not in HIDDEN]
    return [c for c in FIRST if c in shown] + [c for c in shown if c not in FIRST]


def csv_rows(events: DataFrame) -> DataFrame:
    """(song_id, event_idx, row): a CSV row for each event, nulls empty, quotes where needed."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda c: F.when(text(c).rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))
    return events.select("song_id", "event_idx", F.concat_ws(",", *map(quoted, public_columns(events))).alias("row"))


def json_rows(events: DataFrame) -> DataFrame:
    """(song_id, event_idx, row): a JSON object for each event, nulls kept."""
    return events.select("song_id", "event_idx", F.to_json(F.struct(*public_columns(events)), {"ignoreNullFields": "false"}).alias("row"))


def table_rows(events: DataFrame) -> DataFrame:
    """(song_id, event_idx, row): the cells of the printed table."""
    lyric = F.coalesce("lyric", F.lit("")) if "lyric" in events.columns else F.lit("")
    return events.select("song_id", "event_idx", F.concat_ws(" | ", F.col("note"), M.three(F.col("start_time")), M.three(F.col("end_time")), M.three(F.col("confidence")), lyric).alias("row"))


def one_song(events: DataFrame, song_id: int | None = None) -> DataFrame:
    """The events of the song, or of the only one. ValueError where several come without a choice: ``write`` and ``lines`` take those."""
    if song_id is not None:
        return events.where(F.col("song_id") == song_id)
    if events.select("song_id").distinct().limit(2).count() > 1:
        raise ValueError("name a song: the table has several")
    return events


def _rows(events: DataFrame, song_id: int | None) -> list[dict]:
    """One song's events, in order: what a person reads or a small file holds."""
    order = [c for c in ("song_id", "event_idx") if c in events.columns]
    return [r.asDict(recursive=True) for r in one_song(events, song_id).orderBy(*order).select(*public_columns(events)).collect()]


def csv_pieces(rows: Iterable[dict]) -> Iterator[str]:
    """A song's CSV, a row at a time; nothing without rows."""
    out = io.StringIO()
    writer = None
    for r in rows:
        if writer is None:
            writer = csv.DictWriter(out, fieldnames=list(r))
            writer.writeheader()
        writer.writerow({k: "" if v is None else v for k, v in r.items()})
        yield out.getvalue()
        out.seek(0)
        out.truncate()


def json_pieces(rows: Iterable[dict], indent: int | None = 2) -> Iterator[str]:
    """A song's JSON array, a row at a time."""
    pad, between, end = ("", ", ", "]") if indent is None else ("\n" + " " * indent, ",\n" + " " * indent, "\n]")
    some = False
    for r in rows:
        # line feeds inside of values are escaped, those between them are indented once more
        yield (between if some else "[" + pad) + json.dumps(r, indent=indent, ensure_ascii=False).replace("\n", pad)
        some = True
    yield end if some else "[]"


HEADINGS = ("Note", "Start (s)", "End (s)", "Confidence", "Lyric")


def _cells(r: dict) -> list[str]:
    return [r.get("note") or "", *(f"{r.get(c) or 0:.3f}" for c in FIRST[1:4]), r.get("lyric") or ""]


def table_pieces(rows: Iterable[dict], widths: list[int]) -> Iterator[str]:
    """A song's printed table, a row at a time, in columns of these widths."""
    rule = lambda mark: "+" + "+".join(mark * (w + 2) for w in widths) + "+"
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    yield f"{rule('-')}\n{line(HEADINGS)}\n{rule('=')}"
    for i, r in enumerate(rows):
        yield (f"\n{rule('-')}\n" if i else "\n") + line(_cells(r))
    yield f"\n{rule('-')}"


def table_widths(events: DataFrame) -> Column:
    """The widths of the columns of a song's printed table, for each of its rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in events.columns else F.lit("")
    number = lambda c: M.three(F.coalesce(F.col(c), F.lit(0.0))) if c in events.columns else F.lit("0.000")
    cells = (text("note"), *map(number, FIRST[1:4]), text("lyric"))
    w = W.partitionBy("song_id")
    return F.array(*(F.greatest(F.max(F.length(c)).over(w), F.lit(len(h))) for c, h in zip(cells, HEADINGS, strict=True)))


def format_csv(events: DataFrame, song_id: int | None = None) -> str:
    return "".join(csv_pieces(_rows(events, song_id)))


def format_json(events: DataFrame, song_id: int | None = None, indent: int | None = 2) -> str:
    return "".join(json_pieces(_rows(events, song_id), indent))


def format_table(events: DataFrame, song_id: int | None = None) -> str:
    rows = _rows(events, song_id)
    if not rows:
        return "No note events to display."
    widths = [max(map(len, column)) for column in zip(HEADINGS, *map(_cells, rows), strict=True)]
    return "".join(table_pieces(rows, widths))


def format_leadsheet(events: DataFrame, song_id: int | None = None) -> str:
    sheets = [r.text for r in leadsheet.sheets(one_song(events, song_id)).orderBy("song_id").collect()]
    return "\n\n".join(sheets) if sheets else "No note events."


def output(events: DataFrame, format_type: str = "table", output_file: str | None = None, song_id: int | None = None) -> str | None:
    """The text of a format (any case); written to ``output_file``, folders and all, if one is named. ValueError for another format."""
    kind = format_type.lower()
    if kind not in FORMATS:
        raise ValueError(f"format {format_type!r} is none of {', '.join(FORMATS)}")
    text = {"table": format_table, "csv": format_csv, "json": format_json, "leadsheet": format_leadsheet}[kind](events, song_id)
    if output_file is None:
        return text
    path = Path(output_file)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")
    return None


def print_events(events: DataFrame, format_type: str = "table", song_id: int | None = None) -> None:
    print(output(events, format_type, song_id=song_id))


def lines(events: DataFrame, format_type: str = "table") -> Iterator[str]:
    """All songs as lines of text, one partition at a time: the rows of a format, or the leadsheets, under a heading for each song."""
    kind, now = format_type.lower(), None
    if kind not in FORMATS:
        raise ValueError(f"format {format_type!r} is none of {', '.join(FORMATS)}")
    rows = leadsheet.sheets(events).orderBy("song_id") if kind == "leadsheet" else {"table": table_rows, "csv": csv_rows, "json": json_rows}[kind](events).orderBy("song_id", "event_idx")
    for r in rows.toLocalIterator():
        if r.song_id != now:
            now = r.song_id
            yield f"# {now}"
        yield r.text if kind == "leadsheet" else r.row


def write(events: DataFrame, path: str, format_type: str = "parquet", mode: str = "error") -> None:
    """All songs as files, written by all tasks: parquet, json (a row a line), csv with header, table (rows of cells), or leadsheets (a row a song)."""
    kind = format_type.lower()
    if kind == "csv":
        events.select("song_id", "event_idx", *public_columns(events)).write.mode(mode).option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)
    elif kind == "json":
        events.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif kind == "table":
        table_rows(events).repartition("song_id").sortWithinPartitions("song_id", "event_idx").write.mode(mode).option("header", True).csv(path)
    elif kind == "leadsheet":
        leadsheet.sheets(events).write.mode(mode).json(path)
    elif kind == "parquet":
        events.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"format {format_type!r} is none of parquet, table, json, csv, leadsheet")
