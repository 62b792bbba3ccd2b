"""Finding files, choosing their adapter, and reading them as files or lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are read, and folders that are not looked into.
EXTENSIONS = ("jsonl", "json", "ics", "vtt", "srt", "md", "markdown")
SKIPPED = (".git", "node_modules", "target", "dist", "build", ".next", ".venv", "venv", "__pycache__", ".cache", ".claude", ".codex")
CODEX_TYPES = ("session_meta", "response_item", "event_msg", "turn_context")
SNIFFED_LINES = 50


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def discovered(path: Column) -> Column:
    """A file of a known extension that lies in no folder that is skipped."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return extension(path).isin(*EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED)))


def transcript(path: Column) -> Column:
    """A transcript that is not under a subagent's folder."""
    return (extension(path) == "jsonl") & ~F.lower(path).rlike("[^/]*subagent[^/]*/")


def within(cwd: Column, root: str) -> Column:
    """A folder at or below a project's root, by whole path components."""
    base = root.rstrip("/")
    return (cwd == base) | F.startswith(cwd, F.lit(base + "/"))


def decoded_folder(name: Column) -> Column:
    """The path that a transcript folder's name stands for; lossy, so it must be checked to exist."""
    return F.concat(F.lit("/"), F.replace(F.regexp_replace(name, "^-+", ""), F.lit("-"), F.lit("/")))


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, content) of whole files; folders are searched."""
    read = spark.read.option("recursiveFileLookup", "true").text(list(paths), wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")).filter(discovered(F.col("file")))


def lines(files: DataFrame) -> DataFrame:
    """(file, line, value) of the lines of files that are not blank; ``line`` counts from 0."""
    split = files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("line", "value"))
    return split.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).filter("value <> ''")


def parsed(rows: DataFrame, column: str = "value") -> DataFrame:
    """``rows`` with ``v``: the JSON text of a column, parsed once; null if it is not JSON."""
    return rows.withColumn("v", F.try_parse_json(column))


def field(v: Column, *names: str) -> Column:
    """A string at a path of parsed JSON; null if it is no string."""
    path = "$" + "".join(f".{n}" for n in names)
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def has(v: Column, name: str) -> Column:
    """True if parsed JSON is an object with such a field."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "variant").isNotNull(), F.lit(False))


def sniffed(lines: DataFrame) -> DataFrame:
    """(file, kind) of JSON line files by the first telling line of their first fifty."""
    kind = field(F.col("v"), "type")
    telling = (
        F.when(has(F.col("v"), "sessionId") & (F.coalesce(kind, F.lit("")) != ""), "claude")
        .when(has(F.col("v"), "payload") & kind.isin(*CODEX_TYPES), "codex")
        .when(has(F.col("v"), "role") | has(F.col("v"), "text"), "chat")
    )
    first = parsed(lines.filter(F.col("line") < SNIFFED_LINES)).groupBy("file").agg(F.min_by(telling, F.when(telling.isNotNull(), F.col("line"))).alias("kind"))
    return first.select("file", F.coalesce("kind", F.lit("chat")).alias("kind"))


def routed(path: Column, sniffed_kind: Column) -> Column:
    """The adapter of a file; null if there is none."""
    ext = extension(path)
    return (
        F.when(F.endswith(F.lower(path), F.lit(".ide.json")), "ide_history")
        .when(ext.isin("jsonl", "json"), sniffed_kind)
        .when(ext == "ics", "calendar")
        .when(ext.isin("vtt", "srt"), "voice")
        .when(ext.isin("md", "markdown"), "markdown")
    )
