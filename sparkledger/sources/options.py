"""What can be set on a table. Settings are kept beside the manifest and checked when it is opened."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from .errors import SettingsMismatch

FORMAT = 2


@dataclass(frozen=True)
class Options:
    """Defaults are the fixed values of the design: 3 runs a level, maps of 1,000,000 bytes, blocks of 4,000, filters of 3 percent, groups of 4,096 bytes or 10 ms, caches of 5,000,000 bytes."""

    fan: int = 3
    memtable_bytes: int = 1_000_000
    block_bytes: int = 4000
    filter_rate: float = 0.03
    group_bytes: int = 4096
    group_seconds: float = 0.01
    cache_bytes: int = 5_000_000
    max_levels: int | None = None
    codec: str = "zstd"
    checksums: bool = True
    text: bool = True  # keys and values leave the table as text; they are kept as bytes

    def to_json(self) -> bytes:
        return json.dumps({"format": FORMAT, **asdict(self)}, sort_keys=True).encode()

    @classmethod
    def from_json(cls, raw: bytes) -> Options:
        held = json.loads(raw)
        version = held.pop("format", 1)
        if version > FORMAT:
            raise SettingsMismatch(f"the table has format {version}, this code reads up to {FORMAT}")
        while version < FORMAT:
            held = MIGRATIONS[version](held)
            version += 1
        return cls(**{f.name: held[f.name] for f in fields(cls) if f.name in held})

    def checked(self, wanted: Options | None) -> Options:
        """These settings, with those of wanted that may change; a different fan or filter rate of an existing table is an error."""
        if wanted is None:
            return self
        for name in ("fan", "filter_rate"):
            if getattr(self, name) != getattr(wanted, name):
                raise SettingsMismatch(f"{name} is {getattr(self, name)} in the table and {getattr(wanted, name)} in the options")
        return replace(wanted)


#: Format 1 kept no checksums.
MIGRATIONS = {1: lambda held: held | {"checksums": held.get("checksums", False)}}
