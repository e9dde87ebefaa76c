"""Errors with stable codes; no message carries a value, a location, a credential or driver text."""

from __future__ import annotations


class ExpressionError(ValueError):
    def __init__(self, message: str, offset: int):
        super().__init__(f"{message} at {offset}")
        self.offset = offset


class CatalogError(ValueError):
    """All issues of a catalog, sorted by path and message."""

    def __init__(self, issues):
        self.issues = tuple(sorted(set(issues), key=lambda i: (i.path, i.message)))
        super().__init__("; ".join(f"{i.path}: {i.message}" for i in self.issues))


class PlanningError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


#: The codes of source errors are fixed values; what each says is ours.
SOURCE_MESSAGES = {
    "missing_profile": "its runtime profile was not given",
    "missing_arrow_provider": "no dataset was handed over for it",
    "connect_failed": "it can't be reached",
    "bind_failed": "it can't be made ready for this query",
    "cleanup_failed": "something of this query could not be taken away",
    "scan_failed": "reading its rows failed",
    "schema_mismatch": "its columns are not those that the catalog declares",
    "snapshot_mismatch": "its data are no longer those that the session began with",
    "reload_failed": "it can't be read anew, and stays as it was",
    "reload_all_failed": "not every source can be read anew, and all stay as they were",
    "source_initialization_failed": "it can't be set up",
    "unsupported_connector": "no reader is known for the connector type",
    "missing_delta_dependency": "the session has no reader of Delta tables",
    "missing_iceberg_dependency": "the session has no reader of Iceberg tables",
    "extension_unavailable": "a required reader is not on the session's class path",
}


class SourceError(RuntimeError):
    """An error of a source; made of the class that its code belongs to, so that callers may catch by kind."""

    def __new__(cls, code: str, source: str):
        return super().__new__(_CLASSES.get(code, cls) if cls is SourceError else cls, code, source)

    def __init__(self, code: str, source: str):
        self.code, self.source = code if code in SOURCE_MESSAGES else "unknown", source
        super().__init__(f"{source}: {SOURCE_MESSAGES.get(code, 'an error without a known code')}")


class SourceDependencyError(SourceError):
    """Something that the source needs is not there."""


class SourceProfileError(SourceDependencyError):
    """A runtime profile or provider was not given."""


class SourceConnectionError(SourceError):
    """The source can't be reached, made ready or read."""


class SourceSchemaError(SourceError):
    """Columns or content are not those expected."""


class SourceReloadError(SourceError):
    """New readers could not be published."""


_CLASSES = {
    "missing_profile": SourceProfileError, "missing_arrow_provider": SourceProfileError, "unsupported_connector": SourceDependencyError, "extension_unavailable": SourceDependencyError,
    "missing_delta_dependency": SourceDependencyError, "missing_iceberg_dependency": SourceDependencyError, "connect_failed": SourceConnectionError, "bind_failed": SourceConnectionError,
    "scan_failed": SourceConnectionError, "cleanup_failed": SourceConnectionError, "source_initialization_failed": SourceConnectionError, "schema_mismatch": SourceSchemaError,
    "snapshot_mismatch": SourceSchemaError, "reload_failed": SourceReloadError, "reload_all_failed": SourceReloadError,
}


class ExportError(ValueError):
    """An export that is refused: a stable code and what it is about, never a value."""

    def __init__(self, code: str, about: str = ""):
        self.code, self.about = code, about
        super().__init__(f"{code}: {about}" if about else code)


class QueryError(RuntimeError):
    """A query that failed while it ran: an id and a category, never the engine's text."""

    def __init__(self, query_id: str, category: str):
        self.query_id, self.category = query_id, category
        super().__init__(f"query {query_id} failed: {category}")


def category(error: Exception) -> str:
    """The error's class by Spark's condition, as a word of our own."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    for name, starts in (("arithmetic", ("ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO", "NUMERIC_VALUE")), ("conversion", ("CAST_", "CANNOT_PARSE")), ("missing_data", ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "FAILED_READ_FILE")), ("binding", ("UNRESOLVED_COLUMN", "DATATYPE_MISMATCH"))):
        if condition.startswith(starts):
            return name
    return "execution"
