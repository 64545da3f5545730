"""Registered queries: operators applied to the test tables, each with its SQL twin."""

from . import dataflow, state, texts, timeline  # noqa: F401  they register themselves
