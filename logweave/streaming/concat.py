"""Multi-line records in a stream: state per (tag, identifier) with an idle timeout.

The state is the pending record: its head's order, its text, the ids merged and
when it was last touched.  Lines of a key are taken in order of ``_seq``.  In
"strict" mode a line that comes after the wait is emitted alone; in "adopt" mode
it becomes the new pending record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "tag string, identifier string, _seq bigint, text string, ids array<bigint>"
STATE = "seq bigint, text string, size bigint, last double, ids array<bigint>"


class Stitcher:
    """The state machine of one identifier; also used to test the batch form."""

    def __init__(self, max_len: int, wait_sec: float, adopt: bool = False, pending: tuple | None = None):
        self.max_len, self.wait, self.adopt, self.pending = max_len, wait_sec, adopt, pending

    def line(self, seq: int, text: str, head: bool, ts: float) -> list[tuple[int, str, list[int]]]:
        """Records that this line completes."""
        out = []
        p = self.pending
        late = p is not None and ts - p[3] > self.wait
        if head or (late and self.adopt):
            if p is not None:
                out.append(self._take())
            self.pending = (seq, text, len(text.encode()), ts, [seq])
            return out
        if late:
            out.append(self._take())
            p = None
        if p is None:
            return [*out, (seq, text, [seq])]
        self.pending = (p[0], p[1] + text, p[2] + len(text.encode()), ts, [*p[4], seq])
        if self.pending[2] >= self.max_len:
            out.append(self._take())
        return out

    def _take(self) -> tuple[int, str, list[int]]:
        seq, text, _, _, ids = self.pending
        self.pending = None
        return seq, text, ids

    def flush(self) -> list[tuple[int, str, list[int]]]:
        return [self._take()] if self.pending is not None else []


def stream_concat(df: DataFrame, *, max_len: int = 300_000, wait_sec: float = 3.0, adopt: bool = False) -> DataFrame:
    """From (tag, identifier, _seq, text, head boolean, ts seconds) to stitched records.

    Pending records go out when their key is idle for ``wait_sec`` of processing
    time, or when the next head comes.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            seq, text, size, last, ids = state.get
            held = (seq, text, size, last, list(ids))
        m = Stitcher(max_len, wait_sec, adopt, held)
        out = []
        if state.hasTimedOut:
            out = m.flush()
        else:
            for r in pd.concat(list(frames)).sort_values("_seq").itertuples(index=False):
                out += m.line(int(r[2]), r[3], bool(r[4]), float(r[5]))
        if m.pending is None:
            if state.exists:
                state.remove()
        else:
            state.update(m.pending)
            state.setTimeoutDuration(max(1, int(wait_sec * 1000)))
        yield pd.DataFrame({"tag": [key[0]] * len(out), "identifier": [key[1]] * len(out), "_seq": [x[0] for x in out], "text": [x[1] for x in out], "ids": [x[2] for x in out]})

    rows = df.select("tag", "identifier", "_seq", "text", "head", "ts")
    return rows.groupBy("tag", "identifier").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
