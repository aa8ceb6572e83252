"""What a table reports. Lower-level failures stay attached as the cause."""

from __future__ import annotations


class StorageError(Exception):
    """Anything that a table reports."""


class InputOutput(StorageError):
    """The file system failed; the cause tells how."""


class MissingManifest(StorageError):
    """The folder isn't empty and has no manifest."""


class CorruptManifest(StorageError):
    """The newest manifest can't be read."""


class MissingLog(StorageError):
    """The folder isn't empty and has no write-ahead log."""


class CorruptLogEntry(StorageError):
    """A frame names an operation that doesn't exist."""


class UnexpectedFolder(StorageError):
    """The table folder holds a folder that is none of a table's."""


class UnexpectedFile(StorageError):
    """The table folder holds a file that is none of a table's."""


class LevelTooLarge(StorageError):
    """A compaction would make more levels than the options allow."""


class MissingRuns(StorageError):
    """Runs that the manifest names aren't there."""

    def __init__(self, expected: set[str], actual: set[str]) -> None:
        super().__init__(f"expected runs {sorted(expected)}, found {sorted(actual)}; missing: {', '.join(sorted(expected - actual))}")
        self.expected, self.actual = expected, actual


class DamagedRun(StorageError):
    """A run's entries don't give the checksum that was taken when it was written."""


class InvalidMutation(StorageError):
    """Keys, and values of puts, must not be empty; only PUT and DELETE are logged."""


class LateMutation(StorageError):
    """A mutation stands at or below the sequence number under which tombstones were dropped."""


class SettingsMismatch(StorageError):
    """The table was made with other settings, or by a newer format."""


class LeaseHeld(StorageError):
    """Another writer holds the table."""


class Conflict(StorageError):
    """Another commit came first."""
