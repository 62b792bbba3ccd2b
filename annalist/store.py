"""Layered snapshots of facts and controls, published by compare-and-swap.

A revision is a small manifest that names immutable Parquet folders and holds the state (checkpoint,
tasks, dispositions) and the receipts of requests. Publishing creates the next manifest exclusively
through the file system that Spark uses: of two writers with one base, one fails.

A table is a list of layers: the first holds rows as they were, each later one what has changed
since, rows to put in a row's place and the ids of rows that are gone. A change writes its own rows
only; readers merge. A new layer is merged with the one before while that is less than twice its
size, so that a table of n rows has log2 n layers at most and a row is written again as often.
Layers lie in order of id, and beside each lies its word index in order of key, so that a few ids
or keys are found by the statistics of the files. A layer's index is made by the first read that
asks for it, the part for batches and the part for searches each by itself: a layer that is merged
or erased before then, or read as a table only, never has one.

Erasure publishes a revision first in which nothing is left of what is erased. It is a fence: a
writer whose base is older fails as with any other revision, and one whose base is newer names only
clean folders. So older manifests can be put right, and folders deleted that no manifest names any
more, while others write. What is to be done stands in a record until it is done.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.operators import eligibility, erasure, wordindex
from annalist.schemas import CONTROL, FACT
from annalist.storage import held, with_conf, write

TABLES = {"facts": FACT, "controls": CONTROL}
#: File systems whose renames (for local files: links) refuse a name that is taken, in one step. Object stores do not.
EXCLUSIVE = ("file", "hdfs", "viewfs")


#: A layer is merged with the one before if that has fewer than so many times its rows.
GROWTH = 2
#: So many rows, or bytes of statements, fill a file of a layer; of so many bytes of statements a file of an index holds the entries.
FILE_ROWS, FILE_BYTES, INDEXED_BYTES = 200_000, 1 << 25, 1 << 24
#: The entries of so many files of a layer are dealt at once.
INDEXED_FILES = 8
#: Bytes of a dictionary of a file of an index, which is to hold the ids of these files: an id is named many times.
DICTIONARY = str(1 << 23)
#: Beyond so many ids or keys a read looks at all rows.
PUSHED = 20_000
_PUSHDOWN = "spark.sql.parquet.pushdown.inFilterThreshold"


class Conflict(Exception):
    """The base is no longer the head, or a request id came back with another content."""


class Invalid(Exception):
    """A change that must not be published."""


@dataclass(frozen=True)
class Receipt:
    """What a published request came to."""

    revision: int
    replayed: bool


def _columns(name: str) -> list[str]:
    """The names of a table's columns, in order."""
    return [f.split()[0] for f in re.sub(r"<[^>]*>", "", TABLES[name]).split(", ")]


class Store:
    """The store in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.getScheme() not in EXCLUSIVE:
            raise Invalid(f"{self._fs.getScheme()}: a store needs a file system on which of two renames to one name one fails")
        self._fs.mkdirs(self._path(f"{self.root}/revisions"))
        self._fs.mkdirs(self._path(f"{self.root}/intents"))
        self._fs.mkdirs(self._path(f"{self.root}/erasures"))
        # Long lists of ids and keys are compared with the statistics of files, not only their bounds.
        if int(spark.conf.get(_PUSHDOWN)) < PUSHED:
            spark.conf.set(_PUSHDOWN, str(PUSHED))

    # ---- small files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool = False) -> None:
        # Written aside and then given its name: no reader sees half a file.
        path, aside = (self._path(f"{self.root}/{name}{end}") for end in ("", f".{uuid.uuid4().hex}"))
        stream = self._fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if overwrite:
            self._replace(aside, path)
        elif not self._named(aside, path):
            raise Conflict(f"{name} is there already")

    def _replace(self, aside, path) -> None:
        """Put a file in another's place in one step."""
        jvm = self.spark._jvm
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, path, how)

    def _named(self, aside, path) -> bool:
        """Give a file its name unless that is taken; of two that try, one succeeds."""
        if self._fs.getScheme() != "file":
            return not self._fs.exists(path) and self._fs.rename(aside, path)
        # A local rename would replace the other's file; a link is refused.
        try:
            os.link(aside.toUri().getPath(), path.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            self._fs.delete(aside, False)
        return True

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")))

    # ---- revisions

    def head(self) -> int:
        """The number of the newest revision; 0 for an empty store."""
        found = [int(m[1]) for n in self._names("revisions") if (m := re.fullmatch(r"(\d+)\.json", n))]
        return max(found, default=0)

    def revisions(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names("revisions") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def manifest(self, revision: int | None = None) -> dict:
        """Tables, state and receipts of a revision."""
        number = self.head() if revision is None else revision
        if not number:
            return {"tables": {}, "state": {}, "receipts": {}}
        text = self._read(f"revisions/{number:08d}.json")
        if text is None:
            raise Invalid(f"no revision {number}")
        return json.loads(text)

    def layers(self, name: str, revision: int | None = None) -> list[dict]:
        """The layers of a table at a revision, oldest first."""
        return self.manifest(revision)["tables"].get(name, [])

    def table(self, name: str, revision: int | None = None) -> DataFrame:
        """A table as it was at a revision: reads of a pinned revision never change."""
        return self._merged(name, self.layers(name, revision))

    def rows(self, name: str, ids: list[str], revision: int | None = None) -> DataFrame:
        """The rows with these ids, of which there may be a few thousand; other rows' files are passed over."""
        return self._merged(name, self.layers(name, revision), F.col("id").isin(ids) if ids else F.lit(False))

    def indexed(self, keys: list[int], revision: int | None = None, part: str = wordindex.BATCH) -> DataFrame:
        """The entries of a part of the index under these keys, of facts as they are at a revision."""
        layers = self.layers("facts", revision)
        found = None
        for k, layer in enumerate(layers):
            own = self.spark.read.schema(wordindex.INDEX).parquet(f"{self.root}/{self._index(layer, part)}").filter(F.col("key").isin(keys) if keys else F.lit(False))
            own = own.withColumn("_layer", F.lit(k))
            found = own if found is None else found.unionByName(own)
        if found is None:
            return self.spark.createDataFrame([], wordindex.INDEX)
        if len(layers) > 1:
            newest = self._newest(layers).withColumnRenamed("_last", "_now")
            found = found.join(newest, "id", "left").filter("_now is null or _now = _layer").drop("_now")
        return found.drop("_layer")

    def _layer(self, name: str, layer: dict, k: int = 0) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name]}, gone boolean").parquet(f"{self.root}/{layer['folder']}").withColumn("_layer", F.lit(k))

    def _newest(self, layers: list[dict]) -> DataFrame:
        """(id, _last): the last layer, but for the first, that has a row of each id."""
        every = None
        for k, layer in enumerate(layers[1:], 1):
            own = self._layer("facts", layer, k).select("id", "_layer")
            every = own if every is None else every.unionByName(own)
        return every.groupBy("id").agg(F.max("_layer").alias("_last"))

    def _merged(self, name: str, layers: list[dict], keep=None, gone: bool = False) -> DataFrame:
        """The rows of some layers as the last of them leaves them; with ``gone``, also the ids of removed rows."""
        keep = F.lit(True) if keep is None else keep
        out = None
        for k, layer in enumerate(layers):
            own = self._layer(name, layer, k).filter(keep)
            out = own if out is None else out.unionByName(own)
        if out is None:
            return self.spark.createDataFrame([], f"{TABLES[name]}, gone boolean" if gone else TABLES[name])
        # Controls are only ever added.
        if len(layers) > 1 and name == "facts":
            newest = self._newest(layers).filter(keep)
            older = out.filter("_layer = 0").join(newest, "id", "left_anti")
            out = older.unionByName(out.filter("_layer > 0").join(newest, "id").filter("_layer = _last").select(out.columns))
        names = _columns(name)
        return out.select(*names, "gone") if gone else out.filter("not gone").select(names)

    def _size(self, name: str, rows: DataFrame) -> tuple[int, int]:
        """How many rows, and bytes of statements."""
        said = F.sum(F.octet_length("statement")) if name == "facts" else F.lit(None)
        size = rows.agg(F.count("*").alias("rows"), F.coalesce(said, F.lit(0)).cast("long").alias("bytes")).first()
        return size.rows, size.bytes

    def _ranged(self, name: str, rows: DataFrame, size: tuple[int, int] | None = None, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict:
        """Write a layer of ``rows`` (with ``gone``), which are about ``size`` and dealt once, by ranges; what ``finish`` makes of a range is kept."""
        key, (many, said) = "id" if name == "facts" else "target", size or self._size(name, rows)
        files = 1 + max(many // FILE_ROWS, said // FILE_BYTES)
        spread = finish(rows.repartitionByRange(files, key) if files > 1 else rows.coalesce(1))
        return self._stored(name, spread.sortWithinPartitions(key))

    def _stored(self, name: str, rows: DataFrame) -> dict:
        """Write ``rows`` (with ``gone``) as a layer, as they are dealt."""
        folder = f"tables/{name}-{uuid.uuid4().hex}"
        # Of what is gone only its id is kept.
        kept = (F.col(c) if c in ("id", "target") else F.when(~F.col("gone"), F.col(c)).alias(c) for c in _columns(name))
        write(rows.select(*kept, "gone"), f"{self.root}/{folder}")
        layer = {"folder": folder, "rows": self._layer(name, {"folder": folder}).count()}
        return layer | {"index": _index_of(folder)} if name == "facts" else layer

    def _index(self, layer: dict, part: str) -> str:
        """The folder of a part of a layer's index, made if it is not there yet."""
        folder = f"{layer['index']}/{part}"
        if self._fs.exists(self._path(f"{self.root}/{folder}")):
            return folder
        # Written aside and then given its name: no reader sees half an index. Of two that make one, either's is whole.
        aside = f"{folder}.{uuid.uuid4().hex}"
        held = sorted(self._layer("facts", layer).inputFiles())
        for k in range(0, max(len(held), 1), INDEXED_FILES):
            # A few files of the layer at a time, so that no more entries than theirs are being shuffled.
            rows = self.spark.read.schema(f"{FACT}, gone boolean").parquet(*held[k : k + INDEXED_FILES] or [f"{self.root}/{layer['folder']}"]).filter("not gone")
            files = 1 + self._size("facts", rows)[1] // INDEXED_BYTES
            entries = wordindex.entries(rows, part)
            # Keys are hashes, so that equal parts of their range hold about as many: no sample is needed, and words are stemmed once.
            at = F.floor((F.shiftright("key", 32) + (1 << 31)) * files / (1 << 32)).cast("int")
            spread = entries.repartitionById(files, at) if files > 1 else entries.coalesce(1)
            write(spread.sortWithinPartitions("key"), f"{self.root}/{aside}", "append", **{"parquet.dictionary.page.size": DICTIONARY})
        if self._fs.exists(self._path(f"{self.root}/{folder}")) or not self._fs.rename(self._path(f"{self.root}/{aside}"), self._path(f"{self.root}/{folder}")):
            self._fs.delete(self._path(f"{self.root}/{aside}"), True)
        # An erasure names its clean layers before it deletes: what it has deleted meanwhile is not brought back.
        if layer["folder"] not in self._every("facts"):
            self._drop(layer)
        return folder

    def _added(self, name: str, layers: list[dict], rows: DataFrame) -> list[dict]:
        """``layers`` and one of changed ``rows``, merged with those before it that are not much larger."""
        many, said = self._size(name, rows)
        since, size = len(layers), many
        while since and layers[since - 1]["rows"] < GROWTH * size:
            since -= 1
            size += layers[since]["rows"]
        if since == len(layers):
            return [*layers, self._ranged(name, rows, (many, said))]
        names = [*_columns(name), "gone"]
        every = rows.select(*names, F.lit(len(layers)).alias("_layer"))
        for k, layer in enumerate(layers[since:], since):
            own = self._layer(name, layer, k)
            said += self._size(name, own)[1]
            every = every.unionByName(own.select(*names, "_layer"))

        def newest(dealt: DataFrame) -> DataFrame:
            # Rows of an id lie in one range. Controls are only ever added.
            last = dealt.withColumn("_last", F.max("_layer").over(Window.partitionBy("id"))).filter("_layer = _last") if name == "facts" else dealt
            return (last if since else last.filter("not gone")).select(names)

        return [*layers[:since], self._ranged(name, every, (size, said), newest)]

    def publish(
        self,
        base: int,
        request_id: str,
        digest: str,
        tables: dict[str, DataFrame] | None = None,
        state: dict | None = None,
        changes: dict[str, DataFrame] | None = None,
        validators: tuple[Callable[[dict[str, DataFrame]], DataFrame], ...] = (),
    ) -> Receipt:
        """Publish whole tables, or changes of tables, and state on top of ``base``.

        Changes have a table's columns and ``gone``: rows to put in or in the place of others, and those
        to remove. A request that was published before gives its old receipt. A validator takes the new
        rows of each table and returns those that break its rule; any row stops the change.
        """
        if not re.fullmatch(eligibility.REQUEST_ID, request_id):
            raise Invalid(f"request id {request_id!r}")
        manifest = self.manifest()
        known = manifest["receipts"].get(request_id)
        if known:
            if known["digest"] != digest:
                raise Conflict(f"request {request_id} came before with another content")
            return Receipt(known["revision"], True)
        if self.head() != base:
            raise Conflict(f"revision {base} is not the head")
        if (state or {}).get("through_seq", 0) < manifest["state"].get("through_seq", 0) and "through_seq" in (state or {}):
            raise Invalid("a checkpoint never goes back")
        rows = {name: own.withColumn("gone", F.lit(False)) for name, own in (tables or {}).items()} | (changes or {})
        with ExitStack() as stack:
            new = {name: stack.enter_context(held(own)) for name, own in rows.items()}
            fresh = {name: own.filter("not gone").drop("gone") for name, own in new.items()}
            for validator in validators:
                bad = validator(fresh).limit(5).collect()
                if bad:
                    raise Invalid(f"{bad}")
            before = {name: [] if name in (tables or {}) else manifest["tables"].get(name, []) for name in new}
            made = {name: self._added(name, before[name], own) for name, own in new.items()}
        return self._named_next(base, manifest, request_id, digest, manifest["tables"] | made, state)

    def _named_next(self, base: int, manifest: dict, request_id: str, digest: str, tables: dict, state: dict | None = None) -> Receipt:
        receipts = manifest["receipts"] | {request_id: {"digest": digest, "revision": base + 1}}
        try:
            self._write(f"revisions/{base + 1:08d}.json", json.dumps({"tables": tables, "state": manifest["state"] | (state or {}), "receipts": receipts}))
        except Conflict:
            known = {layer["folder"] for layers in manifest["tables"].values() for layer in layers}
            for layer in (layer for layers in tables.values() for layer in layers):
                if layer["folder"] not in known:
                    self._drop(layer)
            raise
        return Receipt(base + 1, False)

    def _drop(self, layer: dict) -> None:
        for folder in {layer["folder"], layer.get("index", layer["folder"])}:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def ever(self, name: str) -> DataFrame:
        """All rows that a table has in any retained revision."""
        out = None
        for layer in self._every(name).values():
            own = self._layer(name, layer)
            out = own if out is None else out.unionByName(own)
        return self.spark.createDataFrame([], TABLES[name]) if out is None else out.filter("not gone").drop("_layer", "gone")

    def _every(self, name: str) -> dict[str, dict]:
        """All layers of a table in all retained revisions, by folder."""
        return {layer["folder"]: layer for n in self.revisions() for layer in self.layers(name, n)}

    # ---- intents: what was asked for, until it is published

    def write_intent(self, request_id: str, content: dict) -> None:
        self._write(f"intents/{request_id}.json", json.dumps(content), overwrite=True)

    def complete_intent(self, request_id: str) -> None:
        self._fs.delete(self._path(f"{self.root}/intents/{request_id}.json"), False)

    def intents(self) -> dict[str, dict | None]:
        """Open intents by request; None for one that cannot be read."""
        out = {}
        for name in self._names("intents"):
            if name.endswith(".json"):
                try:
                    out[name.removesuffix(".json")] = json.loads(self._read(f"intents/{name}") or "")
                except ValueError:
                    out[name.removesuffix(".json")] = None
        return out

    def set_aside(self, request_id: str) -> None:
        """Keep an intent that cannot be replayed out of the way."""
        self._fs.rename(self._path(f"{self.root}/intents/{request_id}.json"), self._path(f"{self.root}/intents/{request_id}.stale"))

    def stale(self) -> int:
        return sum(n.endswith(".stale") for n in self._names("intents"))

    # ---- erasure

    def rewrite(self, base: int, request_id: str, digest: str, needles: DataFrame, controls: DataFrame) -> int:
        """Erase ``needles`` (see ``erasure.sought``) from all layers of facts and the indexes of all revisions; how many layers were replaced.

        The next revision, clean and with ``controls`` added, is published first; ``Conflict`` if
        another one was. Layers that hold no needle stay as they are.
        """
        manifest = self.manifest(base)
        moved: dict[str, dict] = {}
        with held(needles) as needles:
            for folder, layer in self._every("facts").items():
                rows = self._layer("facts", layer).drop("_layer")
                with held(erasure.touched(rows, needles)) as hits:
                    if not hits.isEmpty():
                        # A layer's files stay apart, and in order, so that nothing is shuffled but by a join with very many hits.
                        with with_conf(self.spark, spark__sql__files__maxPartitionBytes=str(FILE_BYTES)):
                            moved[folder] = self._stored("facts", erasure.cleaned(rows, hits).sortWithinPartitions("id"))
            added = {"controls": self._added("controls", manifest["tables"].get("controls", []), controls.withColumn("gone", F.lit(False)))} if not controls.isEmpty() else {}
            # The ids are for the lines of indexes; a revision that is published later has none of these.
            states = [self.manifest(n)["state"] for n in self.revisions()]
            ids = [r.needle for r in needles.filter("is_id").select("needle").collect()] if any(state.get("index") for state in states) else []
            said = erasure.Needles(ids, [r.needle for r in needles.filter("is_statement").select("needle").toLocalIterator() if r.needle in manifest["state"]["index"]]) if manifest["state"].get("index") else erasure.Needles([], [])
        record = f"erasures/{request_id}-{uuid.uuid4().hex}.json"
        self._write(record, json.dumps({"request": request_id, "digest": digest, "moved": moved, "ids": ids}))
        try:
            self._named_next(base, manifest, request_id, digest, self._moved(manifest["tables"], moved) | added, _scrubbed(manifest["state"], said))
        except Conflict:
            self._fs.delete(self._path(f"{self.root}/{record}"), False)
            raise
        return self.finish()

    @staticmethod
    def _moved(tables: dict, moved: dict[str, dict]) -> dict:
        return {name: [moved.get(layer["folder"], layer) for layer in layers] for name, layers in tables.items()}

    def finish(self) -> int:
        """End what was begun to be erased, by this or another process; how many layers were deleted.

        A record whose revision was never published is dropped with the folders that it names.
        """
        done = 0
        for name in self._names("erasures"):
            record = json.loads(self._read(f"erasures/{name}") or "{}")
            moved = record.get("moved", {})
            if self.manifest()["receipts"].get(record.get("request"), {}).get("digest") != record.get("digest"):
                for layer in moved.values():
                    self._drop(layer)
            else:
                needles = erasure.Needles(record["ids"], [])
                for number in self.revisions():
                    manifest = self.manifest(number)
                    fixed = manifest | {"tables": self._moved(manifest["tables"], moved), "state": manifest["state"] | _scrubbed(manifest["state"], needles)}
                    if fixed != manifest:
                        self._write(f"revisions/{number:08d}.json", json.dumps(fixed), overwrite=True)
                # Only what no manifest names any more: a writer may have named a folder meanwhile.
                for folder in set(moved) - set(self._every("facts")):
                    self._drop({"folder": folder, "index": _index_of(folder)})
                    done += 1
            self._fs.delete(self._path(f"{self.root}/erasures/{name}"), False)
        return done


def _index_of(folder: str) -> str:
    return folder.replace("facts", "words")


def _scrubbed(state: dict, needles: erasure.Needles) -> dict:
    """What changes of a state: its index, without lines that hold a needle."""
    return {"index": needles.scrubbed(state["index"])} if state.get("index") else {}
