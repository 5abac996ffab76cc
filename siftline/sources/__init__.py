"""Readers and sinks: scanner reports, bills of materials, lock files, advisories, feeds and source trees as tables."""
