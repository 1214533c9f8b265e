"""Schemas and limits shared by all modules."""

from __future__ import annotations

from dataclasses import dataclass

#: the append-only operation log; ``seq`` alone orders it (arrival order, not event time)
OPS = "seq BIGINT, ts TIMESTAMP, key STRING, op STRING, value STRING"
WRITES = ("put", "update", "delete")

# fixed values: sizes in bytes of the log, run and value-log records, and level limits
RECORD_HEADER = 12
VALUE_HEADER = 4
POINTER_BYTES = 24
ENTRY_BYTES = 20
FOOTER_BYTES = 24
MAX_FIELD_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Limits:
    """When a store flushes and compacts: bytes of the memory table, runs of level 0 and 1, growth by level."""

    flush_bytes: int = 4 * 1024 * 1024
    l0_runs: int = 15
    l1_runs: int = 12
    growth: int = 10

    def of_level(self, level: int) -> int:
        """Most runs that a level holds before it is compacted into the next."""
        return self.l0_runs if level == 0 else min(self.l1_runs * self.growth ** (level - 1), 2**63 - 1)


WEB = Limits(flush_bytes=1024 * 1024)
SMALL = Limits(flush_bytes=32 * 1024, l0_runs=2, l1_runs=2)
