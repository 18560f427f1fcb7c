"""Statistics over repetitions, the metrics file and the console table."""

from __future__ import annotations

import csv
import os
from statistics import median

#: The columns of the metrics file, in order.
COLUMNS = (
    "scheme rep threads build_rows probe_rows build_payload_schema probe_payload_schema partitions distribution match_rate "
    "build_wall_ms build_ns_per_row probe_wall_ms probe_ns_per_row build_shuffle_wall_ms build_shuffle_ns_per_row "
    "probe_shuffle_wall_ms probe_shuffle_ns_per_row eviction_overhead_wall_ms eviction_overhead_ns_per_row e2e_wall_ms "
    "peak_mem_mib bep_budget_mib bep_evictions bep_refinements bep_peak_mib bep_build_skip_retries"
).split()


def stats(values: list[float]) -> tuple[float, float, float]:
    """Median (of an even number, the mean of the middle two), least and greatest."""
    return median(values), min(values), max(values)


def append_csv(path: str, rows: list[dict]) -> None:
    """Append rows; a new file gets the header first. What a strategy doesn't have stays blank."""
    new = not os.path.exists(path)
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, COLUMNS, restval="", extrasaction="raise")
        if new:
            out.writeheader()
        for row in rows:
            out.writerow({k: f"{v:.6f}" if isinstance(v, float) else v for k, v in row.items() if v is not None})


def summary(rows: list[dict]) -> str:
    """Median, least and greatest of every measured column by scheme."""
    lines = []
    for scheme in dict.fromkeys(r["scheme"] for r in rows):
        own = [r for r in rows if r["scheme"] == scheme]
        lines.append(f"{scheme} ({len(own)} repetitions)")
        for c in COLUMNS[10:]:
            if values := [float(r[c]) for r in own if r.get(c) is not None]:
                m, low, high = stats(values)
                lines.append(f"  {c:<32} med {m:>14.3f}  min {low:>14.3f}  max {high:>14.3f}")
    return "\n".join(lines)
