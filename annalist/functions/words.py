"""Word lists and patterns that decide results. Fixed values, stated in natural order."""

# Words that say little about what a fact is about; compared with stems of facts.
FACT_STOPWORDS = (
    "a about an and are as at be been but by can do doe does for from has have how i in is it of on or should "
    "that the thi this to was we what when where which who why with work under over into onto via within without between "
    "after before than then there their them they its also just only all any some each every more most other such same so "
    "if else up out off my our your you me us use need"
).split()

# Words that weigh little when events are searched.
EVENT_STOPWORDS = (
    "a an and are as at be been but by for from has have i in is it of on or that the this to user was were with"
).split()

# Words that are left out before statements are compared.
RESTATEMENT_STOPWORDS = (
    "a an the is are be to of in on for and or with that this it its as by at from has have uses use project user "
    "includes include consists assistant agent must always should only when not no never do does wants want prefers"
).split()

#: Weight of a stopword in both searches, and of a word that only shares a prefix.
STOPWORD_WEIGHT = 0.05
PREFIX_WEIGHT = 0.6
PREFIX_BYTES = 5

# Tags of blocks that a harness puts into a user's turn.
INJECTED_TAGS = (
    "system-reminder local-command-stdout local-command-caveat task-notification environment_context "
    "user_instructions codex_internal_context skill attached_files turn_aborted"
).split()

# Beginnings of turns that are no words of the user.
INJECTED_PREFIXES = (
    "<codex_internal_context",
    "<environment_context",
    "<user_instructions",
    "# AGENTS.md instructions for",
    "<local-command-stdout",
    "<local-command-caveat",
    "<turn_aborted",
    "<task-notification",
    "<system-reminder",
    "<skill",
    "<attached_files",
    "Base directory for this skill",
    "Caveat: The messages below were generated",
    "This session is being continued from a previous conversation",
    "Summary:\n1. Primary Request and Intent",
)

# Patterns of the rule extractor.
NAME_RULE = r"(?i)my name is\s+([A-Z][a-zA-Z\-']+)"
HOME_RULE = r"(?i)I (?:live|am living) in\s+([A-Z][a-zA-Z\-' ]+)"
WISH_RULE = r"(?i)please (?:always|never|don't)\s+([a-z][^.!?]+)"

# Entity id prefixes, the folder of each, and the types that follow from them.
BUCKETS = {"pref_": "preferences", "p_": "people", "o_": "orgs", "w_": "workstreams"}
TYPES = {"pref_": "preference", "p": "person", "o": "org", "w": "workstream", "c": "conversation"}
HEADINGS = {"workstreams": "Project", "people": "People", "orgs": "Organisations", "preferences": "Preferences", "conversations": "Conversations"}
HEADING_ORDER = {"workstreams": 0, "people": 1, "orgs": 2, "conversations": 3, "preferences": 5}

# Kinds of notes by file name.
NOTE_KINDS = {
    "agents.md": "agents",
    "claude.md": "claude",
    "codex.md": "codex",
    "codex.local.md": "codex",
    "readme.md": "readme",
    "copilot-instructions.md": "copilot",
    "windsurfrules.md": "windsurf",
    ".windsurfrules": "windsurf",
}

ROLES = ("user", "assistant", "tool", "system", "note")
VISIBILITIES = ("private", "shared", "public")
