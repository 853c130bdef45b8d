"""Names for helper columns that no frame at hand uses."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(frames: DataFrame | list[DataFrame], *wanted: str) -> list[str]:
    """The wanted names, with underscores behind them until no column of the frames, and none of each other, is called so."""
    frames = frames if isinstance(frames, list) else [frames]
    taken = {c.lower() for frame in frames for c in frame.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
