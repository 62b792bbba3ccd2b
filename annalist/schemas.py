"""The shapes of records. Events are append-only; facts are versioned; controls hide them."""

SOURCE = "source struct<kind:string, custom_kind:string, source_id:string, position:bigint, occurred_at:timestamp>"
#: What an adapter gives; the journal adds ``seq`` and ``ingested_at``.
RAW_EVENT = f"event_id string, scope_id string, session_id string, occurred_at timestamp, role string, {SOURCE}, content string, content_sha256 string, redaction string, metadata string"
EVENT = f"{RAW_EVENT}, seq bigint, ingested_at timestamp"
#: A fact beside what it is about. ``ord`` is its place in the entity.
FACT = (
    "entity_id string, path string, ord bigint, title string, aliases array<string>, entity_type string, entity_visibility string, "
    "id string, predicate string, statement string, kind string, status string, observed_at timestamp, valid_from timestamp, "
    "valid_to timestamp, expires_at timestamp, supersedes array<string>, source_ids array<string>, evidence string, visibility string"
)
#: control: suppressed, retracted, deleted or redacted.
CONTROL = "control string, target string, at timestamp, reason string, state string"
