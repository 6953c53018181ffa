"""Drift of sources as a stateful stream: per address its last content and all it has had."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "url string, old_hash string, new_hash string, old_length long, new_length long, detected_at timestamp"
STATE = "last_hash string, last_length long, seen array<string>"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, length, seen = state.get if state.exists else (None, None, [])
    known = set(seen)
    rows = pd.concat(list(frames)).sort_values(["ts", "seq"])  # of one micro-batch; later batches are later
    size = rows["content_length"].astype("Int64")
    before = pd.DataFrame({"hash": rows["content_hash"].shift(fill_value=last), "length": size.shift(fill_value=pd.NA if length is None else length)})
    new = (~rows["content_hash"].isin(known) & ~rows["content_hash"].duplicated()).to_numpy() & before["hash"].notna().to_numpy()
    end = size.iloc[-1]
    state.update((rows["content_hash"].iloc[-1], None if pd.isna(end) else int(end), sorted(known | set(rows["content_hash"].dropna()))))
    yield pd.DataFrame({"url": key[0], "old_hash": before["hash"][new], "new_hash": rows["content_hash"][new], "old_length": before["length"][new], "new_length": size[new], "detected_at": rows["ts"][new]})


def drift_stream(fetches: DataFrame) -> DataFrame:
    """A null length stays null; the state of an address grows with its distinct contents.

    The events of operators.store.drift_events from a stream of (url, ts, seq, content_hash, content_length).

    Micro-batches are taken in the order of their arrival: a fetch that comes in a later batch counts as later.
    """
    return fetches.groupBy("url").applyInPandasWithState(_update, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)
