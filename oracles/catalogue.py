"""All oracle statements by query name."""

from __future__ import annotations

from oracles import commerce, comparing, delivery, ingest, querylog, scoring
from oracles.views import VIEWS, statement

SOURCES = [commerce, delivery, ingest, comparing, querylog, scoring]


def all_statements() -> dict[str, str]:
    bodies: dict[str, str] = {}
    views = dict(VIEWS)
    for source in SOURCES:
        bodies |= source.BODIES
        views |= getattr(source, "VIEWS", {})
    return {name: statement(body, views) for name, body in sorted(bodies.items())}
