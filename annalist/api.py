"""The engine as a user sees it: seven operations, and what keeps a store in order.

Results of operations are plain values: they are pages of hits or single records. Everything that
grows with the store stays a DataFrame.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.journal import Journal, raw_events
from annalist.operators import change, eligibility, erasure, extract, report, search, similarity, validate, wordindex
from annalist.sources import chats, files, notes
from annalist.storage import cut
from annalist.store import Conflict, Invalid, Receipt, Store
from annalist.streaming import consolidate as batches

JUDGE_BATCH = 60
AUTO_LAG = 200
FACT_COLUMNS = "entity_id path ord title aliases entity_type entity_visibility id predicate statement kind status observed_at valid_from valid_to expires_at supersedes source_ids evidence visibility".split()


Adapter = Callable[[DataFrame], DataFrame]


def _session_store(found: DataFrame) -> DataFrame:
    """Sessions, messages and parts of a store, which lie in folders of these names."""
    own = [found.filter(F.col("file").rlike(f"/{name}/")) for name in ("session", "message", "part")]
    return chats.opencode_store(*own)


#: (kind of events, how files are read) of adapters that no file name or line tells.
ADAPTERS: dict[str, tuple[str, Adapter]] = {
    "session_store": ("chat", _session_store),
    "local_transcript": ("chat", lambda found: chats.local_transcript(files.lines(found))),
}


class NotFound(Exception):
    """No such record, or it may not be shown."""


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def _values(column: DataFrame) -> list:
    """The values of one column, of a batch or a family."""
    return [r[0] for r in column.collect()]


#: What every publication of facts must hold to.
RULES = (lambda tables: eligibility.violations(tables["facts"]),)


class Memory:
    """A store and its journal under one folder."""

    def __init__(self, spark: SparkSession, root: str, reranker: search.Reranker | None = None, adapters: dict[str, tuple[str, Adapter]] | None = None):
        self.spark, self.root, self.reranker = spark, root.rstrip("/"), reranker
        self.adapters = ADAPTERS | (adapters or {})
        self.store, self.journal = Store(spark, f"{self.root}/store"), Journal(spark, f"{self.root}/journal")

    # ---- input

    def ingest(self, *paths: str, scope: str = "personal", session: str = "default", adapter: str | None = None) -> dict[str, int]:
        """Read files of any known format into the journal; how many events were new and skipped.

        ``adapter`` names what reads all of them: session stores, local transcripts or the user's own;
        else each file's format is told by its name and first lines.
        """
        found = cut(files.files(self.spark, *paths))
        if adapter is not None:
            if adapter not in self.adapters:
                raise Invalid(f"no adapter {adapter}")
            kind, read = self.adapters[adapter]
            return self.journal.append(cut(raw_events(read(found), kind, scope, session)), ["file", "line", "event_id"])
        lines = files.lines(found)
        kinds = files.sniffed(lines)
        adapter = files.routed(F.col("file"), F.coalesce("kind", F.lit("chat")))
        chosen = cut(found.select("file").distinct().join(kinds, "file", "left").select("file", adapter.alias("adapter")))

        def own(rows: DataFrame, name: str) -> DataFrame:
            return rows.join(chosen.filter(F.col("adapter") == name).select("file"), "file", "left_semi")

        made = {
            "chat": [chats.chat_export(own(lines, "chat")), chats.claude_transcript(own(lines, "claude")), chats.codex_rollout(own(lines, "codex"), session)],
            "ide_history": [notes.markdown(own(found, "markdown")), notes.ide_history(own(found, "ide_history"))],
            "calendar": [notes.calendar(own(found, "calendar"))],
            "voice": [notes.captions(own(lines, "voice"), F.current_timestamp())],
        }
        events = None
        for kind, parts in made.items():
            for rows in parts:
                one = raw_events(rows, kind, scope, session)
                events = one if events is None else events.unionByName(one)
        return self.journal.append(cut(events), ["file", "line", "event_id"])

    # ---- the seven operations

    def search(self, query: str, limit: int = 8, scope: str | None = None, sources: list[str] | None = None, project: str | None = None, facts_only: bool = False, include_disputed: bool = False, rerank: bool = False, pre_filter: bool = False) -> list[dict]:
        """Facts and events that match. ``pre_filter`` applies the project before the top facts are taken, not after."""
        search.checked(search.condense(query), limit)
        events = None if facts_only else self.journal.events().select(
            "event_id", "seq", "scope_id", "session_id", "role", F.col("source.kind").alias("source_kind"), F.col("source.source_id").alias("source_id"), F.col("source.custom_kind").alias("custom_kind"), "content", "project", "metadata"
        )
        if events is not None:
            events = events.filter(eligibility.in_scope(scope)) if scope else events
            events = events.filter(eligibility.in_project(project)) if project else events
            events = events.filter(eligibility.from_sources(sources or []))
        keep = eligibility.project_entities(project) if project else F.lit(True)
        base = self.store.head()
        facts = self._eligible(include_disputed, base)
        facts = facts.filter(keep) if pre_filter else facts
        keep = keep & eligibility.cites_sources(sources or [])
        found = search.combined(facts, events, query, limit, self.reranker if rerank else None, keep, lambda asked, most: self._best(facts, asked, most, base))
        return [r.asDict() for r in found.orderBy("place").collect()]

    def _best(self, facts: DataFrame, query: str, limit: int, base: int) -> DataFrame:
        """The best of ``facts``, found by the postings of the query's terms; only their own texts are read."""
        keys = search.posting_keys(self.spark, query)
        top = cut(search.search_postings(facts, self.store.indexed([k for _, _, k in keys], base, wordindex.SEARCH), keys, query, limit))
        return self.store.rows("facts", _values(top.select("id")), base).join(top.select("id", "score", "rank"), "id")

    def _eligible(self, include_disputed: bool = False, base: int | None = None) -> DataFrame:
        return eligibility.eligible_facts(self.store.table("facts", base), self.store.table("controls", base), F.current_timestamp(), include_disputed=include_disputed)

    def _readable(self) -> DataFrame:
        return eligibility.readable_facts(self.store.table("facts"), self.store.table("controls"))

    def read(self, record: str) -> dict:
        """An event by its hit id, an entity's current facts, or one fact."""
        if record.startswith("journal:"):
            event_id, _, seq = record.removeprefix("journal:").rpartition("#")
            row = self.journal.lookup(event_id, int(seq)).first() if seq.isdigit() else None
            if row is None:
                raise NotFound(record)
            return {"id": record, "statement": row.content, "label": "current"}
        rows = self._readable().filter((F.col("entity_id") == record) | (F.col("id") == record)).orderBy("ord").collect()
        if rows and rows[0].entity_id == record:
            active = [r for r in rows if r.status == "active"]
            if not active:
                raise NotFound(record)
            return {"id": record, "statement": active[0].statement, "label": "current", "fact_id": active[0].id, "facts": [{"id": r.id, "statement": r.statement} for r in active]}
        if not rows:
            raise NotFound(record)
        label = "current" if rows[0].status == "active" else "non-current"
        return {"id": record, "statement": rows[0].statement, "label": label, "entity_id": rows[0].entity_id}

    def history(self, record: str) -> dict:
        """Every fact of the entity that a record belongs to, with its state."""
        if record.startswith("journal:"):
            return {"id": record, "records": [self.read(record)]}
        facts = self._readable()
        entity = facts.filter((F.col("id") == record) | (F.col("entity_id") == record)).select("entity_id").first()
        if entity is None:
            raise NotFound(record)
        rows = facts.filter(F.col("entity_id") == entity[0]).orderBy("ord").select("id", "statement", "status", text.label(F.col("status")).alias("label")).collect()
        return {"id": entity[0], "records": [r.asDict() for r in rows]}

    def status(self) -> dict:
        """Sizes, lag and open intents."""
        manifest = self.store.manifest()
        row = report.status(self.journal.events(), self.store.table("facts"), manifest["state"].get("through_seq", 0)).first()
        return row.asDict() | {"revision": self.store.head(), "pending": len(self.store.intents()), "stale": self.store.stale()}

    def request_change(self, kind: str, request_id: str, entity_id: str, fact: dict | None = None, target: str | None = None, reason: str = "") -> Receipt:
        """Remember a fact, correct one by another, or forget one. A request is applied once."""
        request = {"kind": kind, "request_id": request_id, "entity_id": entity_id, "fact": fact, "target": target, "reason": reason}
        known = self.store.manifest()["receipts"].get(request_id)
        if known:
            return self.store.publish(0, request_id, _digest(request))
        self.recover()
        return self._apply(request, self.store.head())

    def _apply(self, request: dict, base: int) -> Receipt:
        kind, entity_id, fact, target = (request[k] for k in ("kind", "entity_id", "fact", "target"))
        if kind not in ("remember", "correct", "forget") or not entity_id:
            raise Invalid("a change remembers, corrects or forgets something about an entity")
        if kind != "forget" and not (fact and all(fact.get(k) for k in ("id", "predicate", "statement"))):
            raise Invalid(f"{kind} needs a fact with id, predicate and statement")
        if kind == "forget" and not target:
            raise Invalid("forget needs the id of a fact")
        controls = self.store.table("controls", base)
        family = cut(self._family(entity_id, base))
        about = fact["id"] if kind == "remember" else target or fact["id"]
        holder = family.filter(F.col("id") == about).select("entity_id", "ord").first()
        changes: dict[str, DataFrame] = {}
        if kind != "remember" and holder is None:
            raise Invalid(f"{kind}: {about} is not a fact of {entity_id}")
        here, gone = F.lit(False).alias("gone"), F.lit(True).alias("gone")
        if kind == "forget":
            ids = self.spark.createDataFrame([(target,)], "id string")
            changes["controls"] = change.forgotten(controls, ids, request["reason"]).exceptAll(controls).select("*", here)
            changes["facts"] = family.join(ids, "id", "left_semi").select("*", gone)
        else:
            same = family.filter(F.col("id") == fact["id"]).select("entity_id", "ord").first()
            home = (same or holder).entity_id if same or holder else self._home(family, entity_id, fact["statement"])
            place = same.ord if same else (family.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0] + 1)
            made = self._fact(fact, home, place)
            if kind == "correct":
                old = change.superseded(family.filter(F.col("id") == about), self.spark.createDataFrame([(about, fact["id"])], "id string, new_id string"))
                made = change.upserted(old, made)
            # What was forgotten stays so.
            hidden = F.col("id").isin(_values(change.prunable(controls).filter(F.col("id").isin(fact["id"], about))))
            changes["facts"] = made.select("*", hidden.alias("gone"))
        self.store.write_intent(request["request_id"], {"base": base, "request": request})
        try:
            receipt = self.store.publish(base, request["request_id"], _digest(request), changes=changes, validators=RULES)
        except Invalid:
            self.store.complete_intent(request["request_id"])
            raise
        self.store.complete_intent(request["request_id"])
        return receipt

    def _family(self, entity_id: str, base: int) -> DataFrame:
        """The facts of an entity and its further files; fifty files of bounded size at most."""
        family = text.family(F.lit(entity_id))
        keys = _values(self.spark.range(1).select(wordindex.family_key(family)))
        ids = _values(self.store.indexed(keys, base).select("id").distinct())
        return self.store.rows("facts", ids, base).filter(text.family(F.col("entity_id")) == family)

    def _home(self, family: DataFrame, entity_id: str, statement: str) -> str:
        sizes = family.groupBy("entity_id").agg(F.sum(F.octet_length("statement") + change.FACT_BYTES).alias("n")).collect()  # fifty files at most
        home = change.homes([(r.entity_id, r.n) for r in sizes], entity_id, [len(statement.encode())])[0]
        if home is None:
            raise Invalid(f"{entity_id} is full")
        return home

    def _fact(self, fact: dict, entity_id: str, place: int) -> DataFrame:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        fill = {"entity_id": entity_id, "ord": place, "title": entity_id, "aliases": [], "entity_visibility": "private", "kind": "explicit_assertion", "status": "active", "observed_at": now, "supersedes": [], "source_ids": [], "visibility": "private"}
        row = {c: fact.get(c, fill.get(c)) for c in FACT_COLUMNS} | {"entity_id": entity_id, "ord": place}
        made = self.spark.createDataFrame([tuple(row[c] for c in FACT_COLUMNS)], self.store.table("facts").schema)
        return made.withColumn("path", text.entity_path(F.col("entity_id"))).withColumn("entity_type", F.coalesce("entity_type", text.entity_type(F.col("entity_id"))))

    def recover(self) -> dict[str, str]:
        """Finish changes that were interrupted; those whose base is gone are set aside."""
        out = {}
        self.store.finish()
        for request_id, intent in self.store.intents().items():
            if intent is None:
                self.store.set_aside(request_id)
                out[request_id] = "unreadable"
                continue
            try:
                receipt = self._apply(intent["request"], intent["base"])
                self.store.complete_intent(request_id)
                out[request_id] = "already published" if receipt.replayed else "published"
            except (Conflict, Invalid):
                self.store.set_aside(request_id)
                out[request_id] = "conflict"
        return out

    def tasks_read(self) -> dict:
        """The list of tasks and its version."""
        return self.store.manifest()["state"].get("tasks", {"version": 0, "tasks": []})

    def tasks_update(self, expected_version: int, task: dict, request_id: str) -> dict:
        """Append a task, if the list still has the version that the caller saw."""
        if request_id in self.store.manifest()["receipts"]:
            self.store.publish(0, request_id, _digest(task))
            return self.tasks_read()
        now = self.tasks_read()
        if now["version"] != expected_version:
            raise Conflict(f"version is {now['version']}")
        made = {"version": expected_version + 1, "tasks": [*now["tasks"], task]}
        self.store.publish(self.store.head(), request_id, _digest(task), state={"tasks": made})
        return made

    # ---- upkeep

    def consolidate(self, request_id: str, high_water: int = 200, scope: str | None = "personal", client: extract.Client | None = None, tell: bool = False) -> dict:
        """Extract facts from the next batch of events and publish them with the checkpoint, once.

        Without a client the rules extract; with one, what it proposes passes the gate. With ``tell``
        the client is also given the known entities and their first statements, within a budget.
        """
        base = self.store.head()
        manifest = self.store.manifest(base)
        if request_id in manifest["receipts"]:
            return manifest["state"].get("dispositions", {}).get(request_id, {}) | {"replayed": True}
        through = manifest["state"].get("through_seq", 0)
        last = batches.next_window(self.journal.events(through + 1), through, high_water)
        if last is None:
            return {"through_seq": through, "events": 0, "caught_up": True}
        window = self.journal.events(through + 1).filter(F.col("seq") <= last).select("event_id", "seq", "scope_id", "role", F.col("source.kind").alias("source_kind"), F.col("source.source_id").alias("source_id"), "occurred_at", "content", "project")
        events = cut(window.filter(F.col("scope_id") == scope) if scope else window)
        controls = self.store.table("controls", base)
        if client is None:
            found, set_aside = extract.rule_proposals(events).withColumn("order", F.col("seq") * 1000 + F.col("k")), extract.dispositions(events)
        else:
            facts = self.store.table("facts", base)
            known = facts.groupBy("entity_id").agg(F.first("title").alias("title"))
            told = extract.known_entities(eligibility.eligible_facts(facts, controls, F.current_timestamp())) if tell else None
            gated = cut(extract.gated(extract.model_proposals(extract.candidates(events), client, told), events, known))
            found = gated.filter("reason is null").withColumn("order", F.col("seq") * 1000).withColumn("id", text.fact_id(F.col("entity_id"), F.col("predicate"), F.col("statement")))
            taken = found.select("seq").distinct().withColumn("ok", F.lit(True))
            reason = F.when(~F.col("role").isin("user", "note"), "not a user statement or memory file").when(F.col("ok").isNull(), "no durable fact")
            set_aside = events.join(taken, "seq", "left").select("seq", reason.alias("reason"))
        found = cut(found)
        blocked = eligibility.blocked(controls)
        facts = cut(change.pruned(self._touched(found, events, base), controls))
        good = similarity.placeable(found.select("id", "entity_id", "statement", "order"), facts.filter("status = 'active'").select("id", "entity_id", "statement"), blocked)
        new = found.join(good, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("entity_id", "entity_type", "title", "predicate", "statement", "evidence", "event_id", "seq"), "order").alias("p"), F.min("order").alias("order")).select("id", "order", "p.*")
        new = cut(new)
        # A fact that the family holds already stays in its file; others go to the first with room.
        held = facts.select("id", F.col("entity_id").alias("held"), F.col("ord").alias("held_ord"))
        families = new.select(wordindex.family_key(text.family(F.col("entity_id"))).alias("key")).distinct()
        sizes = self.store.indexed(_values(families), base).groupBy("entity_id").agg(F.sum("bytes").alias("bytes")).withColumn("family", text.family(F.col("entity_id")))
        homes = change.placed(new.join(facts.select("id"), "id", "left_anti").select("id", "entity_id", "statement", "order"), sizes)
        when = events.select("seq", "occurred_at")
        rows = new.join(held, "id", "left").join(homes, "id", "left").join(when, "seq", "left").filter("held is not null or home is not null")
        none = F.array().cast("array<string>")
        home = F.coalesce("held", "home")
        made = rows.select(
            home.alias("entity_id"), text.entity_path(home).alias("path"), F.coalesce("held_ord", F.col("order")).alias("ord"), "title", none.alias("aliases"), "entity_type", F.lit("private").alias("entity_visibility"),
            "id", "predicate", "statement", F.lit("explicit_assertion").alias("kind"), F.lit("active").alias("status"), F.col("occurred_at").alias("observed_at"), *(F.lit(None).cast("timestamp").alias(c) for c in ("valid_from", "valid_to", "expires_at")),
            none.alias("supersedes"), F.array("event_id").alias("source_ids"), "evidence", F.lit("private").alias("visibility"),
        )
        after = cut(change.upserted(facts, made))
        old = extract.outdated(after, events)
        after = change.with_status(after, old, "superseded")
        accepted = set_aside.filter("reason is null").count()
        reasons = {r.reason: list(r.seqs) for r in extract.by_reason(set_aside).collect()}  # a batch is bounded
        result = {"from_seq": through + 1, "through_seq": last, "events": events.count(), "accepted": accepted, "facts": made.join(facts.select("id"), "id", "left_anti").count(), "quarantined": reasons}
        state = {"through_seq": last, "dispositions": manifest["state"].get("dispositions", {}) | {request_id: result}}
        changed = after.join(made.select("id").unionByName(old.select("id")), "id", "left_semi").withColumn("gone", F.lit(False))
        self.store.publish(base, request_id, _digest([request_id, through]), state=state, changes={"facts": changed}, validators=RULES)
        return result | {"caught_up": False}

    def _touched(self, found: DataFrame, events: DataFrame, base: int) -> DataFrame:
        """The facts that proposals may be or restate, and those learned from older versions of notes in a batch.

        Ids and keys of a batch, which is bounded, are looked up; no other facts are read.
        """
        probes = cut(wordindex.probes(found.select("id", "entity_id", "statement").distinct()))
        similar = wordindex.similar_ids(probes, cut(self.store.indexed(_values(probes.select("key").distinct()), base)))
        files = events.filter((F.col("role") == "note") & F.startswith("event_id", F.lit(wordindex.NOTE))).select(wordindex.file_key(F.col("event_id")).alias("key")).distinct()
        learned = self.store.indexed(_values(files), base).select("id")
        ids = _values(found.select("id").unionByName(similar).unionByName(learned).distinct())
        return self.store.rows("facts", ids, base)

    def consolidate_all(self, prefix: str, high_water: int = 200, **options) -> int:
        """Batches until the log is read; how many there were."""
        return self.consolidate_totals(prefix, high_water, **options)["batches"]

    def consolidate_totals(self, prefix: str, high_water: int = 200, **options) -> dict[str, int]:
        """Batches until the log is read: how many, and their events, accepted events and new facts."""
        totals = dict.fromkeys(("batches", "events", "accepted", "facts"), 0)
        while not (found := self.consolidate(f"{prefix}-{self.store.head() + 1}", high_water, **options)).get("caught_up", True):
            totals = {k: n + found.get(k, 1) for k, n in totals.items()}
        return totals

    def due(self) -> bool:
        """True if consolidation lags far enough to run by itself."""
        return self.status()["lag"] >= AUTO_LAG

    def tidy(self, apply: bool = False, keep: tuple[str, ...] = (), judge: Callable[[list[dict]], list[str]] | None = None) -> DataFrame:
        """(id, kind, duplicate_of) of facts that repeat others, or that a judge calls of one session only, twice; with ``apply`` they are forgotten."""
        base = self.store.head()
        old, facts = self.store.table("controls", base), self.store.table("facts", base)
        live = cut(eligibility.readable_facts(facts, old).filter("status = 'active'"))
        doubles = similarity.duplicates(live).select("id", F.lit("duplicate").alias("kind"), "duplicate_of")
        found = cut(doubles)
        if judge:
            rest = live.join(found, "id", "left_anti").select("id", "statement").orderBy("id")

            def asked(stream):
                import pyarrow as pa

                for batch in stream:
                    items = batch.to_pylist()
                    for k in range(0, len(items), JUDGE_BATCH):
                        own = items[k : k + JUDGE_BATCH]
                        passes = (judge(own), judge(own[::-1]))
                        ids, turns = [i for p in passes for i in p], [n for n, p in enumerate(passes) for _ in p]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(turns, pa.int32())], ["id", "turn"])

            named = cut(rest.mapInArrow(asked, "id string, turn int"))
            once = change.agreed(named.filter("turn = 0"), named.filter("turn = 1"), live.limit(0))
            found = found.unionByName(once.select("id", F.lit("session_only").alias("kind"), F.lit(None).cast("string").alias("duplicate_of")))
        found = cut(found.filter(~F.col("id").isin(*keep)) if keep else found)
        if apply:
            controls = change.forgotten(old, found.select("id"), "tidy").exceptAll(old)
            gone = facts.join(found.select("id"), "id", "left_semi")
            self.store.publish(base, f"tidy-{base + 1}", _digest(base), changes={"facts": gone.withColumn("gone", F.lit(True)), "controls": controls.withColumn("gone", F.lit(False))}, validators=RULES)
        return found

    def erase(self, target: str) -> dict[str, int]:
        """Remove a fact or an entity for good: from every revision, with the text of the events it came from.

        Needles are the ids and the statements of what is erased, also of what only older revisions
        still hold. Facts with such an id or statement go, in all revisions; evidence and aliases of other facts
        that name one are emptied, lines of the index dropped. An id that only controls name may be erased. What
        is erased already changes nothing, but for what an interrupted erasure left to do. A revision
        that another writer publishes meanwhile makes it fail with ``Conflict``.
        """
        left = self.store.finish()
        base = self.store.head()
        controls, facts = self.store.table("controls", base), self.store.table("facts", base)
        ever = self.store.ever("facts")
        gone = cut(change.erasure_targets(ever, target))
        n = gone.select("id").distinct().count()
        known = {r.control for r in controls.filter(F.col("target") == target).select("control").distinct().collect()}
        if not n and "deleted" in known:
            return {"facts": 0, "events": 0, "folders": left, "same_statement": 0}
        if not n and not known:
            raise NotFound(target)
        ids = _values(gone.select("id").distinct())
        whole = sorted({r.entity_id for r in gone.filter(F.col("id") != target).select("entity_id").distinct().collect()})
        needles = erasure.Needles([*ids, target, *(f"`{e}`" for e in whole)], _values(gone.select("statement").distinct()))
        also = ever.filter(F.col("statement").isin(needles.statements) & ~F.col("id").isin(ids)) if needles.statements else ever.limit(0)
        same = facts.join(also.select("id").distinct(), "id", "left_semi").select("id").distinct().count()
        events = self.journal.redact(change.source_events(gone))
        named = self.spark.createDataFrame([(i,) for i in sorted({*ids, target})], "id string")
        fresh = named.join(controls.filter("control = 'deleted'").select(F.col("target").alias("id")), "id", "left_anti")
        fresh = cut(fresh.select(F.lit("deleted").alias("control"), F.col("id").alias("target"), F.current_timestamp().alias("at"), F.lit("erased").alias("reason"), F.lit("completed").alias("state")))
        every = erasure.sought(*(self.spark.createDataFrame([(x,) for x in own], f"{c} string") for c, own in (("id", needles.ids), ("statement", needles.statements))))
        folders = self.store.rewrite(base, f"erase-{base + 1}", _digest([target, base]), every, fresh)
        for request_id, intent in self.store.intents().items():
            request = (intent or {}).get("request") or {}
            about = [x for x in (request.get("entity_id"), request.get("target"), (request.get("fact") or {}).get("id")) if x]
            if target in about or set(about) & set(ids) or needles.within(json.dumps(request, ensure_ascii=False)):
                self.store.complete_intent(request_id)
        return {"facts": n, "events": events, "folders": folders + left, "same_statement": same}

    def evaluate(self, cases: list[dict], limit: int = 8, rerank: bool = False) -> DataFrame:
        """Scores of a rubric's cases (id, question, and what is expected)."""
        if not cases:
            raise Invalid("a rubric needs cases")
        hits = [(c["id"], h["place"], h["id"], h["statement"]) for c in cases for h in self.search(c["question"], limit, project=c.get("project"), rerank=rerank)]
        rows = [(c["id"], c.get("category", ""), c.get("expected_fact_ids", []), c.get("must_include", []), c.get("must_not_include", [])) for c in cases]
        wanted = self.spark.createDataFrame(rows, "case_id string, category string, expected array<string>, must_include array<string>, must_not_include array<string>")
        return report.case_scores(wanted, self.spark.createDataFrame(hits, "case_id string, place long, id string, statement string"))

    def index(self) -> str:
        """The index of all entities."""
        facts = self.store.table("facts")
        entities = facts.groupBy("entity_id").agg(F.first("entity_type").alias("entity_type"), F.first("title").alias("title"))
        rows = report.index_rows(report.entity_counts(entities, facts)).orderBy("k").collect()  # cut to a budget of bytes
        return report.INDEX_HEAD + "".join(r.line for r in rows)

    def publish_index(self) -> Receipt | None:
        """Make the index anew and publish it; None if it is as it was."""
        made, base = self.index(), self.store.head()
        if self.store.manifest()["state"].get("index") == made:
            return None
        return self.store.publish(base, f"index-{base + 1}", _digest(made), state={"index": made})

    def session_start(self, entity: str = "pref_user") -> list[dict]:
        """What a session starts with: the user's first preferences and how many facts are current."""
        return [r.asDict() for r in report.session_start(self._readable(), entity).orderBy("ord").collect()]

    def export(self, title: str, current: str | None = None, project: str | None = None, include_file_facts: bool = False) -> str:
        """A file with the managed block of current facts put in."""
        keep: Column | None = eligibility.project_entities(project) if project else None
        return report.spliced(current, report.export_text(title, report.export_lines(self.store.table("facts"), include_file_facts, keep)))

    def export_parts(self, folder: str, project: str | None = None, include_file_facts: bool = False) -> DataFrame:
        """Write an export of any size as ordered part files; (part, lines, bytes) of each."""
        keep: Column | None = eligibility.project_entities(project) if project else None
        return report.write_export(report.export_lines(self.store.table("facts"), include_file_facts, keep), folder)

    def validate(self) -> DataFrame:
        """(problem, what) of everything that should not be in the store."""
        facts, controls = self.store.table("facts"), self.store.table("controls")
        forms = eligibility.violations(facts).select(F.col("reason").alias("problem"), F.col("id").alias("what"))
        targets = validate.unknown_targets(controls, facts).select(F.lit("unknown target").alias("problem"), F.col("target").alias("what"))
        cited = validate.unknown_references(facts, facts, "statement").select(F.lit("unknown reference").alias("problem"), F.col("reference").alias("what"))
        kinds = controls.filter(~F.col("control").isin("suppressed", "retracted", "deleted", "redacted") | F.col("target").isNull())
        odd = kinds.select(F.lit("unknown control").alias("problem"), F.col("target").alias("what"))
        through = self.store.manifest()["state"].get("through_seq", 0)
        ahead = self.journal.events().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last")).filter(F.col("last") < through)
        late = ahead.select(F.lit("checkpoint beyond the log").alias("problem"), F.lit(str(through)).alias("what"))
        return forms.unionByName(targets).unionByName(cited).unionByName(odd).unionByName(late)
