"""Errors that callers may want to tell apart."""


class QueryError(ValueError):
    """A query that does not fit the schema or the grammar."""


class ArtifactError(RuntimeError):
    """A derived table that is stale, unpaired or inconsistent."""
