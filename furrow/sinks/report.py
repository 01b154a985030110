"""Text reports of a cleaning."""

from __future__ import annotations

from dataclasses import asdict
from pathlib import Path
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from furrow.plans.cleaning import CleanResult


def write(result: CleanResult, file: str, source: str = "unknown", column: str = "Yield_kg_ha") -> str:
    """Numbers before and after for each field, deletions by step, delays and parameters; small tables all."""
    lines = [f"Source: {source}", "", "Before and after"]
    for row in result.validation(column).toLocalIterator():
        lines += ["  " + ", ".join(f"{k}: {v:.4g}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.asDict().items())]
    lines += ["", "Deleted by step", *(f"  {r['step']}: {r['n']}" for r in result.by_step().toLocalIterator())]
    if result.delays is not None:
        lines += ["", "Delays", *("  " + ", ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in result.delays.toLocalIterator())]
    lines += ["", "Parameters", *(f"  {k}: {v}" for k, v in asdict(result.params).items())]
    Path(file).parent.mkdir(parents=True, exist_ok=True)
    Path(file).write_text("\n".join(lines) + "\n")
    return file
