"""Appends as a stateful stream: each stream's tail and last seq are kept in the state store.

Needs spark.sql.streaming.stateStore.providerClass to be RocksDB's (see PROVIDER).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "stream_id string, arrival long, status string, idx long, offset string, data string"


class AppendProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("log", "tail long, last_seq string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, last = self.state.get() if self.state.exists() else (0, None)
        every = pd.concat(list(rows)).sort_values("arrival")  # a micro-batch's rows of one stream come in any order
        out = []
        for arrival, body, seq in zip(every["arrival"], every["body"], every["seq"]):
            seq = seq if isinstance(seq, str) and seq else None
            if not body:
                out.append((key[0], arrival, "bad_request", None, None, None))
            elif seq is not None and last is not None and seq.encode() <= last.encode():
                out.append((key[0], arrival, "conflict", None, None, None))
            else:
                tail, last = tail + 1, seq if seq is not None else last
                out.append((key[0], arrival, "ok", tail, f"{tail:010d}", body))
        self.state.update((tail, last))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"idx": "Int64"})

    def close(self) -> None:
        pass


def append(appends: DataFrame) -> DataFrame:
    """A streaming DataFrame (stream_id, arrival, body, seq) with status, idx and offset."""
    return appends.groupBy("stream_id").transformWithStateInPandas(AppendProcessor(), OUT, "Append", "None")
