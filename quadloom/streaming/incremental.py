"""Incremental results: streams of bindings without repeats, and partial cardinalities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups that the distinct rows are dealt to by their hash; one call folds all rows of a group that a batch brings.
PAGES = 512
#: Copies of a row that one record brings back from Python.
COPIES = 1000
#: JSON that gives each value back as it was.
EXACT_JSON = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_PAGE = pa.schema([("row", pa.large_string()), ("most", pa.int64()), ("current", pa.int64()), ("shown", pa.int64())])


def _packed(page: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PAGE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(page)
    return sink.getvalue().to_pybytes()


def _fold(page: pa.Table, counts: pd.Series) -> tuple[pa.Table, pd.DataFrame]:
    """The state after so many copies of rows by (row, run), and how many copies of which rows pass."""
    code, names = pd.factorize(counts.index.get_level_values(0))
    new, runs, n = pa.array(names, pa.large_string()), counts.index.get_level_values(1).to_numpy(), counts.to_numpy()
    at = pc.index_in(new, value_set=page["row"])
    known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    fresh = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
    place = np.empty(len(new), np.int64)
    place[known] = at.drop_null().to_numpy()
    place[fresh] = len(page) + np.arange(len(fresh))
    most, current, shown = (np.concatenate([page[c].to_numpy(), np.full(len(fresh), first)]) for c, first in (("most", 0), ("current", -1), ("shown", 0)))
    passed = np.zeros(len(new), np.int64)
    for run in np.unique(runs):
        here = code[runs == run]
        spot = place[here]
        now = np.where(current[spot] == run, shown[spot], 0) + n[runs == run]
        passed[here] += np.maximum(now - most[spot], 0)
        most[spot] = np.maximum(most[spot], now)
        current[spot], shown[spot] = run, now
    rows = pa.chunked_array([*page["row"].chunks, new.take(pa.array(fresh))], pa.large_string())
    pieces = -(-passed // COPIES)
    owner = np.repeat(np.arange(len(new)), pieces)
    left = passed[owner] - COPIES * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return pa.table([rows, most, current, shown], schema=_PAGE), pd.DataFrame({"row": np.asarray(names, object)[owner], "copies": np.minimum(left, COPIES).astype(np.int32)})


def replay_suppressed(stream: DataFrame, columns: list[str], run: str = "run") -> DataFrame:
    """Rows of restarted runs without those that an earlier run has emitted, by multiplicity.

    ``run`` numbers the runs. For each distinct row the state keeps the most copies that any run
    has shown and the copies shown by the current run; a copy passes once it exceeds the former.
    Unbound (null) columns are values like any other: rows are compared as JSON, whole, and a
    null run comes before all others. The distinct rows lie in ``PAGES`` states, so that a batch
    takes one call per page and not one per row.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false", **EXACT_JSON})

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = [pdf.groupby(["row", "run"], sort=False).size() for pdf in batches if len(pdf)]
        if not counts:
            return
        page = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else _PAGE.empty_table()
        page, out = _fold(page, counts[0] if len(counts) == 1 else pd.concat(counts).groupby(level=[0, 1], sort=False).sum())
        state.update((_packed(page),))
        yield out

    rows = stream.select(row.alias("row"), F.coalesce(F.col(f"`{run}`").cast("long"), F.lit(-1).cast("long")).alias("run")).withColumn("page", F.pmod(F.xxhash64("row"), F.lit(PAGES)))
    passed = rows.groupBy("page").applyInPandasWithState(fold, "row string, copies int", "page binary", "append", GroupStateTimeout.NoTimeout)
    kinds = dict(stream.dtypes)
    back = F.from_json("row", ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(columns)), {"mode": "FAILFAST", **EXACT_JSON})
    return passed.select(F.inline(F.array_repeat(back, F.col("copies")))).toDF(*columns)


def partial_cardinalities(stream: DataFrame, dataset: str = "src") -> DataFrame:
    """Running number of rows per dataset, for metadata that grows during traversal."""
    return stream.groupBy(dataset).agg(F.count("*").alias("cardinality"))
