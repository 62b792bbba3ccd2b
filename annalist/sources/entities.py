"""Entity files: Markdown with a front matter of facts, parsed and rendered.

The front matter has a line ``key: value`` for each key, the value in JSON, which is YAML as well.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.digests import ordered_md5

ENTITY = (
    "struct<id:string, type:string, title:string, aliases:array<string>, links:array<string>, visibility:string, "
    "facts:array<struct<id:string, predicate:string, statement:string, kind:string, status:string, observed_at:string, valid_from:string, valid_to:string, "
    "expires_at:string, supersedes:array<string>, sources:array<struct<event_id:string, role:string, evidence:string>>, visibility:string>>>"
)

#: The parser of JSON gives null for a string of over 20 million characters, unless told otherwise.
LONG = {"maxStringLen": str(2**31 - 1)}


def parsed(content: str) -> tuple[dict, str]:
    """(front matter, body) of an entity file; ValueError if it is not one."""
    text = content.lstrip("﻿")
    front, mark, body = text.removeprefix("---\n").partition("\n---\n")
    if not text.startswith("---\n") or not mark:
        raise ValueError("an entity file begins with a front matter between lines of ---")
    found = {}
    for line in front.split("\n"):
        key, colon, value = line.partition(": ")
        if not colon:
            raise ValueError(f"no front matter: {line[:40]}")
        try:
            found[key] = json.loads(value)
        except ValueError:
            found[key] = value
    for key in ("id", "type", "title"):
        if not isinstance(found.get(key), str) or not found[key]:
            raise ValueError(f"an entity needs {key}")
    for fact in found.setdefault("facts", []):
        if not all(fact.get(k) for k in ("id", "predicate", "statement")):
            raise ValueError("a fact needs id, predicate and statement")
        if fact.get("valid_from") and fact.get("valid_to") and fact["valid_from"] > fact["valid_to"]:
            raise ValueError("a fact ends before it begins")
    found.setdefault("visibility", "private")
    return found, body.lstrip("\n")


def rendered(entity: dict, body: str | None = None) -> str:
    """An entity file; private visibility is not written, and the body lists the current facts if none is given."""
    keys = [k for k in ("schema_version", "id", "type", "title", "aliases", "links", "facts", "visibility") if k in entity]
    front = "\n".join(f"{k}: {json.dumps(entity[k], ensure_ascii=False)}" for k in keys if (k, entity[k]) != ("visibility", "private"))
    if body is None:
        body = f"# {entity['title']}\n\n## Current facts\n\n" + "".join(f"- [{f['id']}] {f['statement']}\n" for f in entity.get("facts", []) if f.get("status") == "active")
    return f"---\n{front}\n---\n\n{body}" + ("" if body.endswith("\n") else "\n")


def parse(files: DataFrame) -> DataFrame:
    """Flat facts of entity files (file, content); files that cannot be parsed are left out."""

    def one(content: str) -> str | None:
        try:
            return json.dumps(parsed(content)[0])
        except ValueError:
            return None

    found = files.select(F.col("file").alias("path"), F.from_json(F.udf(one, "string", useArrow=True)("content"), ENTITY, LONG).alias("e")).filter("e is not null")
    rows = found.select("path", "e", F.posexplode("e.facts").alias("ord", "f"))
    return rows.select(
        F.col("e.id").alias("entity_id"), "path", "ord", F.col("e.title").alias("title"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), F.col("e.type").alias("entity_type"),
        F.col("e.visibility").alias("entity_visibility"), "f.id", "f.predicate", "f.statement", "f.status", F.coalesce("f.visibility", F.lit("private")).alias("visibility"),
        *(F.col(f"f.{c}").cast("timestamp").alias(c) for c in ("valid_from", "valid_to", "expires_at")),
        F.transform(F.coalesce("f.sources", F.array().cast("array<struct<event_id:string, role:string, evidence:string>>")), lambda s: s["event_id"]).alias("source_ids"),
    )


def _body_head(title: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n## Current facts\n\n"))


def _body_line(id_: Column, statement: Column) -> Column:
    return F.concat(F.lit("- ["), id_, F.lit("] "), statement, F.lit("\n"))


def body(title: Column, facts: Column) -> Column:
    """The body of an entity: its title and its active facts (id, statement, status), in order."""
    active = F.filter(facts, lambda f: f["status"] == "active")
    return F.concat(_body_head(title), F.array_join(F.transform(active, lambda f: _body_line(f["id"], f["statement"])), ""))


def body_digests(facts: DataFrame) -> DataFrame:
    """(title, md5): the MD5 of each entity's ``body``, which may be of any size, from its facts (title, ord, id, statement, status)."""
    heads = facts.select("title").distinct().select("title", F.lit(0).alias("part"), F.lit(None).cast(facts.schema["ord"].dataType).alias("ord"), _body_head(F.col("title")).alias("line"))
    lines = facts.filter("status = 'active'").select("title", F.lit(1).alias("part"), "ord", _body_line(F.col("id"), F.col("statement")).alias("line"))
    found = ordered_md5(heads.unionByName(lines), "title", ["part", "ord"], "line")
    return found.select("title", F.when(F.col("title").isNotNull(), F.col("md5")).alias("md5"))
