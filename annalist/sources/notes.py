"""Adapters for whole files: notes, calendars, captions and IDE histories. Input is (file, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.sources.chats import _rows
from annalist.sources.files import field, parsed


def _name(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def _stem(file: Column) -> Column:
    return F.regexp_replace(_name(file), r"\.[^.]*$", "")


def markdown(files: DataFrame) -> DataFrame:
    """Each file as one note; its id holds a hash of its content, so that an edited file is a new note."""
    body = F.regexp_replace("content", "^﻿+", "")
    where = F.concat(F.lit("md:"), "file", F.lit(":"), F.left(F.sha2(body, 256), F.lit(16)))
    parent = F.coalesce(F.try_element_at(F.split("file", "/"), F.lit(-2)), F.lit(""))
    folder = F.regexp_replace("file", "/[^/]*$", "")
    meta = F.to_json(F.struct(_name(F.col("file")).alias("file_name"), text.note_kind(_name(F.col("file"))).alias("kind"), parent.alias("rel_path"), folder.alias("project")))
    rows = files.withColumn("line", F.lit(0)).filter(body != "")
    return _rows(rows, where, 0, F.lit(None).cast("timestamp"), F.lit("note"), body, meta)


def calendar(files: DataFrame) -> DataFrame:
    """Events of a calendar: id, start and summary; ``position`` counts them."""
    blocks = F.regexp_extract_all("content", F.lit(r"(?is)BEGIN:VEVENT\s*\n(.*?)END:VEVENT"), 1)
    rows = files.select("file", F.posexplode(blocks).alias("line", "block"))

    def last(key: str) -> Column:
        found = F.regexp_extract_all("block", F.lit(rf"(?m)^{key}:(.*?)\s*$"), 1)
        return F.try_element_at(found, F.lit(-1))

    known = rows.filter(last("UID").isNotNull() | last("DTSTART").isNotNull() | last("SUMMARY").isNotNull())
    place = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    known = known.withColumn("at", place)
    none = F.lit("")
    return _rows(known, F.trim(F.coalesce(last("UID"), none)), F.col("at"), text.calendar_time(F.trim(last("DTSTART"))), F.lit("note"), F.coalesce(last("SUMMARY"), none), F.lit("{}"))


def captions(lines: DataFrame, start: Column) -> DataFrame:
    """Each spoken line of a caption file; its time is ``start`` plus the offset of the cue it follows.

    Lines of digits before a cue are its number, not speech.
    """
    v = F.col("value")
    cue = F.contains(v, F.lit("-->"))
    offset = text.cue_offset(F.trim(F.split(v, "-->")[0]))
    spoken = ~cue & ~v.rlike("^[0-9]+$") & ~F.startswith(v, F.lit("WEBVTT")) & ~F.startswith(v, F.lit("NOTE"))
    before = Window.partitionBy("file").orderBy("line")
    rows = lines.withColumn("cue", F.last(F.when(cue, F.struct(offset.alias("ms"))), True).over(before)).filter(spoken)
    rows = rows.withColumn("at", F.row_number().over(before) - 1)
    when = F.timestamp_micros(F.unix_micros(start) + F.col("cue.ms") * 1000)
    return _rows(rows, _stem(F.col("file")), F.col("at"), when, F.lit("note"), v, F.lit("{}"))


def ide_history(files: DataFrame) -> DataFrame:
    """Commands of an IDE's history, with their results as metadata."""
    items = F.from_json(F.get_json_object("content", "$.events"), "array<string>")
    rows = files.select("file", F.posexplode(items).alias("line", "item"))
    rows, one = parsed(rows, "item"), F.col("v")
    where = F.coalesce(field(one, "id"), F.concat(_stem(F.col("file")), F.lit("_"), F.col("line").cast("string")))
    result = F.coalesce(F.get_json_object("item", "$.result"), F.lit(None))
    quoted = F.when(field(one, "result").isNotNull(), F.to_json(F.struct(result.alias("result")))).otherwise(F.concat(F.lit('{"result":'), F.coalesce(result, F.lit("null")), F.lit("}")))
    return _rows(rows, where, F.col("line"), F.try_to_timestamp(field(one, "ts")), F.lit("tool"), F.coalesce(field(one, "command"), F.lit("")), quoted)
