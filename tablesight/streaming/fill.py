"""Ordered fill on a stream: forward fill in event-time order inside groups, then the first
value backwards, as ``functions.ordered.fill_forward_backward`` does on a table.

A row waits in the keyed state of its group until the watermark has passed its event time, as
an earlier row may still come; then it takes the last value of its group. A row before the first
value of its group (a leading gap) waits for that value, or with ``leading_wait`` until
the watermark is that much later, and goes out with the gap. The state of a group is its rows
inside the watermark delay, its leading gaps, and one value per column; it is in the
checkpoint, so a restarted query goes on with it.

Rows later than the watermark are dropped by Spark. Rows without an event time go out at once
and unfilled. Rows still waiting when a stream ends stay in its checkpoint. One group is
handled in one task per trigger.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import col

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_AS_TEXT = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType, T.StringType, T.DateType)


def _to_text(field: T.StructField) -> Column:
    """A text that ``_from_text`` turns back into the same value (pandas has no whole
    numbers or times with gaps that keep all their digits)."""
    c, kind = col(field.name), field.dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, _AS_TEXT):
        return c.cast("string")
    raise TypeError(f"column {field.name} of type {kind.simpleString()} cannot pass a streaming fill")


def _from_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(c.cast("long"))
    if isinstance(kind, T.BinaryType):
        return F.unbase64(c)
    return c.cast(kind)


class GroupFill:
    """The waiting rows of one group. A row is [event time in microseconds, tie keys, texts]."""

    def __init__(self, fill: Sequence[int], state: str | None = None):
        self.fill = list(fill)
        self.open, self.leading, self.last = json.loads(state) if state else ([], [], [None] * len(self.fill))

    def dump(self) -> str:
        return json.dumps([self.open, self.leading, self.last])

    def advance(self, watermark_us: int, leading_wait_us: int | None) -> list[list]:
        """The texts of the rows that are complete at this watermark."""
        closed = sorted((r for r in self.open if r[0] <= watermark_us), key=lambda r: (r[0], [(k is not None, k) for k in r[1]]))
        self.open = [r for r in self.open if r[0] > watermark_us]
        for row in closed:
            texts = row[2]
            for i, at in enumerate(self.fill):
                if texts[at] is None:
                    texts[at] = self.last[i]
                    continue
                if self.last[i] is None:  # the group's first value
                    for before in self.leading:
                        if before[2][at] is None:
                            before[2][at] = texts[at]
                self.last[i] = texts[at]
            self.leading.append(row)
        done, wait = [], []
        for row in self.leading:
            whole = all(row[2][at] is not None for at in self.fill)
            tired = leading_wait_us is not None and row[0] + leading_wait_us <= watermark_us
            (done if whole or tired else wait).append(row)
        self.leading = wait
        return [r[2] for r in done]

    def next_time(self, leading_wait_us: int | None) -> int | None:
        """When (in microseconds) the next row can go out without a new one coming."""
        times = [r[0] for r in self.open]
        if leading_wait_us is not None:
            times += [r[0] + leading_wait_us for r in self.leading]
        return min(times, default=None)


def fill_stream(stream: DataFrame, columns: Sequence[str], event_time: str, group_by: Sequence[str], tie_keys: Sequence[str] = (),
                delay: str = "10 minutes", leading_wait_seconds: float | None = None) -> DataFrame:
    """``stream`` with the gaps of ``columns`` filled in (event_time, tie_keys) order inside
    each group; append mode."""
    fields = stream.schema.fields
    names = [f.name for f in fields]
    fill, ties = [names.index(c) for c in columns], [names.index(c) for c in tie_keys]
    whole = [isinstance(fields[i].dataType, _WHOLE) for i in ties]
    n, groups = len(fields), [f"__g{i}" for i in range(len(group_by))]
    wait = None if leading_wait_seconds is None else int(leading_wait_seconds * 1_000_000)
    texts = [f"c{i}" for i in range(n)]
    rows = stream.withWatermark(event_time, delay).select(
        col(event_time).alias("__time"), F.unix_micros(col(event_time)).cast("string").alias("__us"),
        *[col(c).alias(g) for c, g in zip(group_by, groups)], *[_to_text(f).alias(t) for f, t in zip(fields, texts)])

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group = GroupFill(fill, state.get[0] if state.exists else None)
        out: list[list] = []
        for pdf in pdfs:
            for us, *values in pdf[["__us", *texts]].itertuples(index=False, name=None):
                values = [None if pd.isna(v) else v for v in values]
                if pd.isna(us):
                    out.append(values)
                    continue
                tie = [int(values[i]) if w and values[i] is not None else values[i] for i, w in zip(ties, whole)]
                group.open.append([int(us), tie, values])
        mark = max(0, state.getCurrentWatermarkMs())
        out += group.advance(mark * 1_000, wait)
        state.update((group.dump(),))
        nxt = group.next_time(wait)
        if nxt is not None:  # it fires once the watermark is later than this
            state.setTimeoutTimestamp(max(-(-nxt // 1_000) - 1, mark, 1))
        yield pd.DataFrame(out, columns=texts, dtype=object)

    filled = rows.groupBy(*groups).applyInPandasWithState(
        run, ", ".join(f"{t} string" for t in texts), "waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    return filled.select(*[_from_text(F.col(t), f.dataType).alias(f.name) for t, f in zip(texts, fields)])
