"""Corner drags in a stream of touch events: what is held between events is state of the session.

Events are ``session, ts, seq, kind, corner, dx, dy``: ``touch`` takes a corner of the unit-square
quad, ``move`` shifts it, ``lift`` ends the gesture. A last small step that came shortly before lifting is a
wiggle of the finger and taken back. ``reset`` puts the quad back to where it began.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The quad that a session begins with; fixed values: a wiggle's longest step and its longest time (ms) before lifting.
START, WIGGLE, WIGGLE_MS = (0.2, 0.2, 0.8, 0.2, 0.8, 0.8, 0.2, 0.8), 0.02, 150
EVENTS = "session long, ts timestamp, seq long, kind string, corner int, dx double, dy double"


def moved(quad: list[float], corner: int, dx: float, dy: float) -> list[float]:
    """The quad with one corner shifted within the unit square; as it was if that isn't convex."""
    out = list(quad)
    for i, d in ((2 * corner, dx), (2 * corner + 1, dy)):
        out[i] = min(1.0, max(0.0, out[i] + d))
    x, y = out[::2], out[1::2]
    turn = lambda i, j, k: (x[j] - x[i]) * (y[k] - y[j]) - (y[j] - y[i]) * (x[k] - x[j])
    return out if all(turn(i, (i + 1) % 4, (i + 2) % 4) > 0 for i in range(4)) else quad


class CornerDrag(StatefulProcessor):
    """A session's quad, the corner held (-1: none), the quad before the last step, that step's length and time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        named = [f"{part}{i} double" for part in ("q", "before") for i in range(8)]
        self.held = handle.getValueState("held", ", ".join([*named, "corner int", "step double", "at long"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        have = self.held.get() if self.held.exists() else (*START, *START, -1, 0.0, 0)
        quad, before, corner, step, at = list(have[:8]), list(have[8:16]), have[16], have[17], have[18]
        out = []
        for e in batch.itertuples(index=False):
            ms = int(e.ts.timestamp() * 1000)
            if e.kind == "touch":
                corner, before, step, at = (int(e.corner) if 0 <= e.corner <= 3 else -1), quad, 0.0, ms
            elif e.kind == "reset":
                quad, before, corner, step = list(START), list(START), -1, 0.0
            elif e.kind == "move" and corner >= 0:
                before, quad = quad, moved(quad, corner, e.dx, e.dy)
                step, at = (e.dx**2 + e.dy**2) ** 0.5, ms
            elif e.kind == "lift" and corner >= 0:
                if 0 < step <= WIGGLE and ms - at <= WIGGLE_MS:
                    quad = before
                corner, step = -1, 0.0
            out.append((key[0], e.seq, *quad))
        self.held.update((*map(float, quad), *map(float, before), int(corner), float(step), int(at)))
        yield pd.DataFrame(out, columns=["session", "seq", *(f"q{i}" for i in range(8))])

    def close(self) -> None:
        pass


def drag_stream(events: DataFrame) -> DataFrame:
    """``session, seq, q0 .. q7``: the quad after each event, corner by corner as x, y.

    The session must use the RocksDB state store.
    """
    schema = "session long, seq long, " + ", ".join(f"q{i} double" for i in range(8))
    return events.groupBy("session").transformWithStateInPandas(CornerDrag(), schema, "Append", "None")
