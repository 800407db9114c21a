"""Error kinds."""


class LithicError(Exception):
    """Base of all errors of this package."""


class SchemaMismatch(LithicError):
    """Rows don't fit the declared schema."""


class NullViolation(LithicError):
    """A null would be stored in a column declared not null."""


class UniqueViolation(LithicError):
    """A key of a unique index would occur twice."""


class MergeConflict(LithicError):
    """A merge source has a duplicate or null key."""


class CommitConflict(LithicError):
    """Another writer committed first."""


class SnapshotNotFound(LithicError):
    """No such sequence."""


class TableNotFound(LithicError):
    """No such table."""


class Corrupt(LithicError):
    """Stored files contradict each other."""


class Unsupported(LithicError):
    """The statement is outside what mutations accept."""
