"""Runs from end to end: building feature tables, the baseline, challengers, and the relational experiment."""
