"""Which facts may be seen: status, dates, visibility and controls; and filters of events and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.functions import words as W


def eligible(now: Column, include_disputed: bool = False) -> Column:
    """Active (or disputed, if asked for) and neither expired, ended nor yet to begin; a null date is no bound."""
    status = F.col("status").isin("active", "disputed") if include_disputed else F.col("status") == "active"
    return (
        status
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > now))
        & (F.col("valid_from").isNull() | (F.col("valid_from") <= now))
    )


def visible(audience: str) -> Column:
    """Both the entity and the fact may be shown to the audience."""
    least = W.VISIBILITIES.index(audience)
    return (text.visibility_rank(F.col("entity_visibility")) >= least) & (text.visibility_rank(F.col("visibility")) >= least)


def uncontrolled(facts: DataFrame, controls: DataFrame, kinds: tuple[str, ...] = ("suppressed", "retracted", "deleted")) -> DataFrame:
    """Facts that no control of these kinds names.

    The anti-join is left to the optimizer: controls are broadcast only while they are small.
    """
    hidden = controls.filter(F.col("control").isin(*kinds)).select(F.col("target").alias("id"))
    return facts.join(hidden, "id", "left_anti")


def eligible_facts(facts: DataFrame, controls: DataFrame, now: Column, audience: str = "private", include_disputed: bool = False) -> DataFrame:
    """The facts that a search may return."""
    return uncontrolled(facts.filter(eligible(now, include_disputed) & visible(audience)), controls)


def readable_facts(facts: DataFrame, controls: DataFrame) -> DataFrame:
    """The facts that may be read by id: what is retracted may, what is suppressed or deleted may not."""
    return uncontrolled(facts, controls, ("suppressed", "deleted"))


def in_scope(scope: str) -> Column:
    return F.col("scope_id") == scope


def in_project(project: str) -> Column:
    """The event's project, by folder name (ASCII case ignored) or by path; a trailing ``/`` does not count."""
    wanted = project.rstrip("/")
    same = F.lower(text.project_name(F.col("project"))) == wanted.lower()
    return F.col("project").isNotNull() & (same | (F.col("project") == wanted))


def project_entities(project: str) -> Column:
    """The project's entity, the user's preferences, and the spill files of either."""
    from re import sub

    base = sub("[^a-z0-9]+", "_", project.lower()).strip("_")[:60].rstrip("_")
    number = F.regexp_extract("entity_id", r"_\+?0*([0-9]+)$", 1)
    within = (F.char_length(number) < 10) | ((F.char_length(number) == 10) & (number <= "4294967295"))
    return F.col("entity_id").isin(f"w_{base}", "pref_user") | (F.col("entity_id").rlike(rf"^(w_{base}|pref_user)_\+?[0-9]+$") & within)


def from_sources(prefixes: list[str]) -> Column:
    """Events whose id, or whose chat id, begins with any prefix; case does not count. No prefix: all."""
    out = F.lit(not prefixes)
    for p in map(str.lower, prefixes):
        out = out | F.startswith(F.lower("event_id"), F.lit(p)) | ((F.col("source_kind") == "chat") & F.startswith(F.lower("source_id"), F.lit(p)))
    return out


def _any_starts(column: str, start: str) -> Column:
    return F.exists(column, lambda x: F.startswith(x, F.lit(start)))


def cites_sources(prefixes: list[str]) -> Column:
    """Facts of which a source begins with any prefix; case counts. No prefix: all."""
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | _any_starts("source_ids", p)
    return out


def from_files_only() -> Column:
    """Facts with sources, all of them notes in files."""
    return (F.size("source_ids") > 0) & F.forall("source_ids", lambda x: F.startswith(x, F.lit("evt_ide_md:")))


def violations(facts: DataFrame) -> DataFrame:
    """(id, reason) of facts that lack an id, a predicate or a statement, or end before they begin."""
    reasons = F.array_compact(
        F.array(
            *(F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"empty {c}")) for c in ("id", "predicate", "statement")),
            F.when(F.col("valid_from") > F.col("valid_to"), F.lit("ends before it begins")),
        )
    )
    return facts.select("id", F.explode(reasons).alias("reason"))


# The files that may be written, and the forms of ids.
PATHS = (
    r"(?:PROFILE|ONEPAGER|INDEX)\.md",
    r"memory/(?:people|orgs|preferences|conversations|workstreams)/[A-Za-z0-9_-]{1,80}\.md",
    r"sessions/[A-Za-z0-9_-]{1,80}/(?:RECAP|TASKS)\.md",
    r"state/(?:checkpoint|controls)\.json",
    r"state/dispositions/[A-Za-z0-9_-]{1,80}\.json",
)
REQUEST_ID = "^[A-Za-z0-9_-]{1,80}$"
REVISION = "^([0-9a-f]{40}|[0-9a-f]{64})$"
ENTITY_ID = "^(?:p|o|pref|c|w)_[A-Za-z0-9_-]{1,80}$"


def writable(path: Column) -> Column:
    """A path of the whitelist; the whole path must match."""
    return path.rlike(f"^(?:{'|'.join(PATHS)})$")


def asks_something(prompt: Column) -> Column:
    """No command, and three words at least."""
    found = F.trim(prompt)
    return ~F.startswith(found, F.lit("/")) & (F.size(F.filter(F.split(found, r"\s+"), lambda x: x != "")) >= 3)


def blocked(controls: DataFrame) -> DataFrame:
    """(target): what may not be extracted again, each once."""
    return controls.filter(F.col("control").isin("suppressed", "deleted")).select("target").distinct()
