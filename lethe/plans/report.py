"""Reports as text and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Heading and field of each column of the modes' table.
COLUMNS = (
    ("policy", "name"), ("erased unreadable", "alice_unique_gone"), ("shared whole", "bob_identical_ok"), ("mixed names erased", "bob_mixed_has_alice"),
    ("live bytes", "live_bytes_after"), ("live/unshared, before", "space_vs_never_share_before"), ("after", "space_vs_never_share_after"), ("erasure, ms", "erase_ms"),
)


def mode_table(rows: list[dict]) -> str:
    """A line of headings and one for each mode, columns as wide as they need."""
    lines = [[heading for heading, _ in COLUMNS], *([str(row[field]) for _, field in COLUMNS] for row in rows)]
    widths = [max(map(len, column)) for column in zip(*lines)]
    return "\n".join(" | ".join(x.ljust(n) for x, n in zip(line, widths)).rstrip() for line in lines)


def to_json(result: dict) -> str:
    return json.dumps(result, indent=2)


def restore_text(subject: str, snapshot_id: str, files: DataFrame, flagged: bool) -> str:
    """One line for each file, in path order, with the first 60 bytes."""
    rows = files.select("path", "ok", "unrestorable", F.coalesce(F.substring("data", 1, 60), F.lit(bytearray())).alias("head")).orderBy("path")
    lines = [f"{r['path']}: ok={r['ok']} unrestorable={r['unrestorable']} data={bytes(r['head'])!r}" for r in rows.toLocalIterator()]
    return "\n".join([f"{subject} at {snapshot_id}, holds an erased subject: {flagged}", *(f"  {x}" for x in lines)])
