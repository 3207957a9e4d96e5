"""Registered queries: each runs a library operator over the given tables, next to the SQL that
computes the same rows independently."""

from __future__ import annotations

from . import alerting, baselines, detections, reporting, scalars, sources

ENTRIES = {}
for _module in (scalars, sources, detections, baselines, alerting, reporting):
    for _name, _entry in _module.ENTRIES.items():
        assert _name not in ENTRIES, _name
        ENTRIES[_name] = _entry
