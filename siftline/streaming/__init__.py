"""Incremental triage: findings arrive as files, verdicts leave as files, each decided once."""
