"""All queries and oracles of the library."""

from __future__ import annotations

from sieveline.plans import copies, corpus, flows, judgements, logs_and_settings, markup, relations, reporting, rules, toolchain  # noqa: F401  register
from sieveline.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "q_clone_groups"
