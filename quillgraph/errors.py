"""Errors of use cases. The class name is the error type that users see."""

from __future__ import annotations


class LibraryError(Exception):
    """An expected failure of a use case."""


class DatabaseNotInitialized(LibraryError):
    pass


class DatabaseMigrationFailed(LibraryError):
    pass


class InvalidIdentifier(LibraryError):
    def __init__(self, scheme: str, value: str):
        super().__init__(f"invalid identifier {scheme}:{value!r}")
        self.scheme, self.value = scheme, value


class _Missing(LibraryError):
    what = "object"

    def __init__(self, key: object):
        super().__init__(f"{self.what} not found: {key}")
        self.key = key


class PaperNotFound(_Missing):
    what = "paper"


class DocumentNotFound(_Missing):
    what = "document"


class SourceNotFound(_Missing):
    what = "source"


class WorkNotFound(_Missing):
    what = "work"


class ProviderWorkNotFound(_Missing):
    what = "provider's work for paper"


class PaperNotIdentifiable(_Missing):
    what = "identifier of paper"


class SourceNotADirectory(LibraryError):
    pass


class ProviderError(LibraryError):
    pass


class SelfCitation(LibraryError):
    pass


class CitationPathNotFound(LibraryError):
    pass


class IdentifierConflict(LibraryError):
    """Identifiers that belong to other papers: (scheme, normalized value, paper id), sorted."""

    def __init__(self, conflicts: list[tuple[str, str, str]]):
        self.conflicts = sorted(conflicts)
        super().__init__(
            "identifiers belong to other papers: " + ", ".join(f"{s}:{v} ({p})" for s, v, p in self.conflicts)
        )
