"""What a run is set up with: a project's root and name, a store's place, settings from a file."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_root(cwd: str) -> str:
    """The nearest folder at or above ``cwd`` that holds ``.git``; else ``cwd`` itself."""
    at = os.path.normpath(cwd)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        above = os.path.dirname(at)
        if above == at:
            return os.path.normpath(cwd)
        at = above


def project_roots(cwd: Column) -> Column:
    """``project_root`` of each row, each folder looked up once in a worker; the files must be where Spark runs."""
    known: dict[str, str] = {}

    def one(folder: str | None) -> str | None:
        if folder is None:
            return None
        if folder not in known:
            known[folder] = project_root(folder)
        return known[folder]

    return F.udf(one, "string", useArrow=True)(cwd)


def settings(text: str, environment: Mapping[str, str]) -> dict[str, str]:
    """KEY=value lines, with comments, ``export`` and quotes; what the environment sets wins."""
    found = {}
    for line in text.splitlines():
        match = re.match(r"""\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^#]*))""", line)
        if match and not line.lstrip().startswith("#"):
            quoted = next((g for g in match.groups()[1:3] if g is not None), None)
            found[match[1]] = quoted if quoted is not None else match[4].strip()
    return found | {k: v for k, v in environment.items() if k in found}


def store_root(cwd: str, explicit: str | None = None, scope: str | None = None, environment: str | None = None, shared: str = "~/.annalist") -> str:
    """Where a store is: a given path, else the shared or the project's one if asked for, else the environment's, the nearest one, the shared one."""
    own = os.path.join(project_root(cwd), ".annalist")
    if explicit:
        return explicit
    if scope in ("global", "local"):
        return os.path.expanduser(shared) if scope == "global" else own
    if environment:
        return environment
    at = os.path.normpath(cwd)
    while True:
        if os.path.isdir(os.path.join(at, ".annalist")):
            return os.path.join(at, ".annalist")
        above = os.path.dirname(at)
        if above == at:
            return os.path.expanduser(shared)
        at = above
