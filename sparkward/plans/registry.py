"""All registered queries: ``{name: (function of session and folder, SQL or None)}``."""

from __future__ import annotations

from sparkward.plans import queries_checks, queries_governed, queries_policy

REGISTERED = {**queries_checks.QUERIES, **queries_policy.QUERIES, **queries_governed.QUERIES}
