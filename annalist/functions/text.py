"""Text functions as columns: all run in the JVM, none calls Python."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions import words as W

_GAP = r"[^\p{L}\p{N}_-]+"


def _listed(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, ``-`` and ``_``."""
    return F.filter(F.split(F.lower(text), _GAP), lambda x: x != "")


def stem(word: Column) -> Column:
    """The word without a light suffix; short words are left alone."""
    return _stem(F.lower(word))


def _stem(w: Column) -> Column:
    """``stem`` of a word in lower case."""

    def ends(suffix: str, least: int) -> Column:
        return F.endswith(w, F.lit(suffix)) & (F.char_length(w) >= least + len(suffix))

    def without(n: int) -> Column:
        return F.substring(w, F.lit(1), F.char_length(w) - n)

    hissing = F.lit(False)
    for suffix in ("ses", "xes", "zes", "ches", "shes"):
        hissing = hissing | F.endswith(w, F.lit(suffix))
    return (
        F.when(ends("ing", 3), without(3))
        .when(ends("ed", 3), without(2))
        .when(ends("es", 3) & hissing, without(2))
        .when(ends("s", 3) & ~F.endswith(w, F.lit("ss")), without(1))
        .otherwise(w)
    )


def stems(text: Column) -> Column:
    """The distinct stems of a text's tokens."""
    return F.array_distinct(F.transform(F.array_distinct(tokens(text)), _stem))


def content_words(statement: Column) -> Column:
    """The distinct stems that count when statements are compared; stopwords go before stemming."""
    # Without stopwords, and each word once, before any is stemmed.
    found = F.array_except(F.split(F.lower(statement), r"[^\p{L}\p{N}]+"), _listed([*W.RESTATEMENT_STOPWORDS, ""]))
    return F.array_distinct(F.transform(found, _stem))


def content_terms(text: Column) -> Column:
    """The distinct stems of over two characters that are no stopwords of facts."""
    stop = _listed(W.FACT_STOPWORDS)
    return F.filter(F.array_except(stems(text), stop), lambda x: F.char_length(x) > 2)


def prefix(word: Column) -> Column:
    """The first five bytes of a word that has as many and ends a character there; else null."""
    head = F.substring(word.cast("binary"), 1, W.PREFIX_BYTES)
    return F.when((F.octet_length(word) >= W.PREFIX_BYTES) & F.is_valid_utf8(head.cast("string")), head.cast("string"))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one ``_``; 60 characters at most."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.left(F.regexp_replace(joined, "^_+|_+$", ""), F.lit(60)), "_+$", "")


def fact_id(entity_id: Column, predicate: Column, statement: Column) -> Column:
    """The id of a fact: twelve hexadecimal digits of what it says about what."""
    return F.concat(F.lit("fact_"), F.left(F.sha2(F.concat_ws("|", entity_id, predicate, F.lower(statement)), 256), F.lit(12)))


def event_id(kind: Column, source_id: Column, position: Column, custom: Column) -> Column:
    """The id of an event, from where it came."""
    at = F.concat(source_id, F.lit("_"), position.cast("string"))
    return (
        F.when(kind == "chat", F.concat(F.lit("evt_chat_"), source_id))
        .when(kind == "calendar", F.concat(F.lit("evt_cal_"), at))
        .when(kind == "voice", F.concat(F.lit("evt_voice_"), at))
        .when(kind == "ide_history", F.concat(F.lit("evt_ide_"), at))
        .when(kind == "custom", F.concat(F.lit("evt_"), custom, F.lit("_"), at))
    )


def source_label(kind: Column, source_id: Column, custom: Column) -> Column:
    """What a source is called in results: for a chat, what precedes the first colon."""
    return (
        F.when(kind == "chat", F.split_part(source_id, F.lit(":"), F.lit(1)))
        .when(kind == "ide_history", F.lit("ide"))
        .when(kind == "custom", custom)
        .otherwise(kind)
    )


def clip(text: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis in place of the rest."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def first_lines(text: Column, lines: int) -> Column:
    """The first lines that are not blank, trimmed, and ``...`` if there are more."""
    full = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    shown = F.array_join(F.slice(full, 1, lines), "\n")
    more = F.when(F.size(full) > lines, F.lit("\n...")).otherwise(F.lit(""))
    return F.when((F.lit(lines) == 0) | (text == ""), F.lit("")).when(F.size(full) == 0, F.lit("")).otherwise(F.concat(shown, more))


def normalised(text: Column) -> Column:
    """Text for the comparison of quotes: no list markers or marks, plain quotes and dashes, single spaces, lower case."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*([-+] )?", ""), r"^[0-9]+[.] ", ""))
    plain = F.translate(F.array_join(lines, "\n"), "‘’“”–—*`#>|", "''\"\"--")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def own_words(text: Column) -> Column:
    """What the user typed in a turn; null if nothing was. Injected blocks, image tags and temporary paths go."""
    tags = "|".join(W.INJECTED_TAGS)
    rest = F.regexp_replace(text, rf"(?s)<({tags})(?:\s[^>]*)?>.*?</({tags})>", "")
    rest = F.regexp_replace(rest, r"^\s+", "")
    foreign = rest == ""
    for start in W.INJECTED_PREFIXES:
        foreign = foreign | F.startswith(rest, F.lit(start))
    opened = F.split(rest, "<command-args>")
    arguments = F.trim(F.split(F.try_element_at(opened, F.lit(2)), "</command-args>")[0])
    plain = F.regexp_replace(rest, r"(?s)<image[^>]*>.*?</image>|<image[^>]*/?>|\[Image #\d+\]", "")
    kept = F.filter(F.split(plain, "\r?\n"), lambda x: ~x.rlike(r"^\s*(/var/folders/|/tmp/)"))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"\n$", "")
    return F.when(foreign, F.lit(None)).when(F.startswith(rest, F.lit("<command-")), arguments).otherwise(joined)


def role(name: Column) -> Column:
    """A known role; else null."""
    return F.when(name.isin(*W.ROLES), name)


def note_kind(file_name: Column) -> Column:
    """What kind of note a file is, by its name."""
    out = F.lit("project_markdown")
    for name, kind in W.NOTE_KINDS.items():
        out = F.when(F.lower(file_name) == name, F.lit(kind)).otherwise(out)
    return out


def calendar_time(stamp: Column) -> Column:
    """A UTC time or a date (its midnight); else null."""
    return F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(stamp, F.lit("yyyyMMdd")))


def cue_offset(stamp: Column) -> Column:
    """Milliseconds of ``h:m:s.ms``; null if it is not of that form."""
    part = [F.regexp_extract(stamp, r"^(\d+):(\d+):(\d+)(?:\.(\d+))?(?:\..*)?$", k) for k in (1, 2, 3, 4)]
    whole = [F.try_to_number(p, F.lit("999999999")).cast("long") for p in part]
    return ((whole[0] * 60 + whole[1]) * 60 + whole[2]) * 1000 + F.coalesce(whole[3], F.lit(0))


def reference_tokens(text: Column) -> Column:
    """Ids that a text cites in brackets."""
    return F.regexp_extract_all(text, F.lit(r"\[((?:fact_|id_)[A-Za-z0-9_]*)\]"), 1)


def family(entity_id: Column) -> Column:
    """The entity id without the number of a spill file."""
    return F.regexp_replace(entity_id, r"^(.*_.*)_\+?[0-9]+$", "$1")


def bucket(entity_id: Column) -> Column:
    """The folder of an entity."""
    out = F.lit("conversations")
    for start, folder in reversed(W.BUCKETS.items()):
        out = F.when(F.startswith(entity_id, F.lit(start)), F.lit(folder)).otherwise(out)
    return out


def entity_path(entity_id: Column) -> Column:
    """The path of an entity's file."""
    return F.concat(F.lit("memory/"), bucket(entity_id), F.lit("/"), F.regexp_replace(entity_id, "^(pref_|p_|o_|w_|c_)", ""), F.lit(".md"))


def entity_type(entity_id: Column) -> Column:
    """The type of a new entity, from its id."""
    out = F.lit("thing")
    for start, kind in reversed(W.TYPES.items()):
        out = F.when(F.startswith(entity_id, F.lit(start)), F.lit(kind)).otherwise(out)
    return out


def heading(folder: Column) -> Column:
    """The heading of a folder in an export."""
    out = F.replace(folder, F.lit("_"), F.lit(" "))
    for name, title in W.HEADINGS.items():
        out = F.when(folder == name, F.lit(title)).otherwise(out)
    return out


def heading_order(folder: Column) -> Column:
    """Where a folder stands in an export."""
    out = F.lit(4)
    for name, rank in W.HEADING_ORDER.items():
        out = F.when(folder == name, F.lit(rank)).otherwise(out)
    return out


def label(status: Column) -> Column:
    """``current`` for an active fact."""
    return F.when(status == "active", F.lit("current")).otherwise(F.lit("non-current"))


def visibility_rank(visibility: Column) -> Column:
    """private 0, shared 1, public 2; a missing one is private."""
    return F.coalesce(F.array_position(_listed(W.VISIBILITIES), visibility) - 1, F.lit(0))


def project_name(root: Column) -> Column:
    """The last segment of a project's path."""
    return F.element_at(F.split(F.regexp_replace(root, "/+$", ""), "/"), -1)


def sigmoid(x: Column) -> Column:
    """A logit as a score from 0 to 1."""
    return 1 / (1 + F.exp(-x))


def relevance(raw: Column, confidence: Column) -> Column:
    """A judged relevance of 0 to 3 times its confidence, each clamped."""
    return F.least(F.greatest(raw / 3, F.lit(0.0)), F.lit(1.0)) * F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))


def without_fence(reply: Column) -> Column:
    """A reply without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), "^```(json)?", ""), "```$", ""))
