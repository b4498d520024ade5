"""The streaming twin of contract histories: the state of each school's contract is kept between batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.contracts import EVENTS, HISTORY, Contract, Plan, told


def history(events: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """HISTORY from a stream of EVENTS that come batch by batch in order of time; within a batch they are put in order.

    Notices come from tick events, so a school's state needs no timer; a contract is never finished, so its state stays.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        contract = Contract(plans, state.get[0] if state.exists else None)
        rows = pd.concat(frames).sort_values(["at", "seq"], kind="stable")
        none = lambda x, kind: None if pd.isna(x) else kind(x)
        events = [(r.at.to_pydatetime(), int(r.seq), none(r.kind, str), none(r.plan, str), none(r.months, int), none(r.used, int)) for r in rows.itertuples()]
        out = told(contract, int(key[0]), events)
        state.update((contract.saved(),))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in HISTORY.split(", ")]).astype({"amount": "Int64", "at": "datetime64[us]", "start": "datetime64[us]", "end": "datetime64[us]"})

    rows = events.select(F.col("school").cast("long").alias("school"), F.col("at").cast("timestamp_ntz").alias("at"), F.col("seq").cast("long").alias("seq"), *EVENTS[3:])
    return rows.groupBy("school").applyInPandasWithState(run, HISTORY, "saved string", "append", GroupStateTimeout.NoTimeout)


def append_history(events: DataFrame, plans: dict[str, Plan], out: str, state: str) -> StreamingQuery:
    """Starts the query: rows are appended to `out` once each, whatever is restarted; it ends when all that is there is read."""
    return history(events, plans).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
