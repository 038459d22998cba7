"""All core queries and their SQL, by name."""

from sightweave.plans import decisions, frames, identity, live, matching, timeline

MODULES = [timeline, identity, decisions, frames, matching, live]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
