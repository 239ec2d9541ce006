"""The same rules on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "label string, at double, event long"


def entity_events(stream: DataFrame, entity: str, label: str, time: str, gap_s: float, lateness: str = "10 minutes") -> DataFrame:
    """(entity, label, time, event): rows of each entity numbered by events, which open at another label (null always differs) or after gap_s.

    State is the entity's last label, time and number. A row without a time comes first in its batch and has no gap. Within a batch rows are put in time order; across batches
    the order is that of arrival, and rows later than the watermark are dropped.
    """
    kinds = dict(stream.dtypes)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, event = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("time", kind="stable", na_position="first")
        at_s = (rows["time"] - pd.Timestamp(0)).dt.total_seconds()
        known = at_s.ffill()
        before, labels, previous = known.shift().fillna(float("nan") if at is None else at), rows["label"], rows["label"].shift()
        previous.iloc[0] = last
        opens = labels.isna() | previous.isna() | (labels != previous) | (at_s - before > gap_s)
        numbers = event + opens.cumsum()
        end, seen = labels.iloc[-1], known.iloc[-1]
        state.update((None if pd.isna(end) else end, at if pd.isna(seen) else float(seen), int(numbers.iloc[-1])))
        yield pd.DataFrame({"entity": key[0], "label": labels, "time": rows["time"], "event": numbers})

    rows = stream.withWatermark(time, lateness).selectExpr(f"`{entity}` AS entity", f"`{label}` AS label", f"`{time}` AS time")
    schema = f"entity {kinds[entity]}, label string, time timestamp, event long"
    return rows.groupBy("entity").applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
