"""Current state from an append-only change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.keyed import latest_per_key


def current_state(log: DataFrame, key: list[str], as_of: str | None = None, version: tuple[str, str] = ("commit_ts", "seq"), op: str = "op", deleted: str = "D") -> DataFrame:
    """The last event of each key, unless it is a delete; as_of ignores later commits.

    An update without an insert counts, a delete without one leaves nothing, equal
    commit times are ordered by sequence, and replaying a log changes nothing. Events
    without an op are dropped like deletes.
    """
    ts, seq = version
    if as_of is not None:
        log = log.filter(F.col(ts) <= F.lit(as_of).cast(log.schema[ts].dataType))
    last = latest_per_key(log, key, [F.desc(ts), F.desc(seq)], [F.col(op)])
    return last.filter(F.col(op) != deleted).drop(op, seq)
