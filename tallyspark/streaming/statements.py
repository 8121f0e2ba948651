"""Statements as they arrive. Extensions: the batch engine has no streams of its own to match.

Files are read as they land in a folder and go through the batch plans in foreachBatch; the balance rule can also be checked row by row, with
what an account's next rows need held as state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

CHECKED = "doc_id long, idx long, amount_cents long, balance_cents long, previous long, agrees boolean, late boolean"
ROWS = 10_000


OUT = Row(*[c.split()[0] for c in CHECKED.split(", ")])


class ChainKeeper(StatefulProcessor):
    """Holds the last row of an account up to which none is missing, and the rows beyond it that came too early."""

    def __init__(self, first: int, patience_ms: int | None) -> None:
        self.first, self.patience_ms = first, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "idx long, balance_cents long")
        self.waiting = handle.getMapState("waiting", "idx long", "amount_cents long, balance_cents long")

    def _reached(self) -> tuple[int, int | None]:
        last = self.last.get()
        return (self.first - 1, None) if last is None else (last[0], last[1])

    @staticmethod
    def _check(key: tuple, idx: int, amount: int | None, printed: int | None, previous: int | None) -> Row:
        agrees = None if None in (previous, printed, amount) else previous + amount == printed
        return OUT(key[0], idx, amount, printed, previous, agrees, False)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """State is read and written for rows that still wait when the others of their batch have been seen, not for each row."""
        rows, reached = iter(rows), self._reached()
        (idx, balance), held = reached, self.waiting.exists()
        while part := sorted(islice(rows, ROWS), key=lambda r: r.idx):
            ahead: dict[int, tuple] = {}
            for r in part:
                at, amount, printed = r.idx, r.amount_cents, r.balance_cents
                if at <= idx or at in ahead or (held and self.waiting.containsKey((at,))):
                    yield OUT(key[0], at, amount, printed, None, None, True)
                    continue
                if at != idx + 1:
                    ahead[at] = (amount, printed)
                    continue
                yield self._check(key, at, amount, printed, balance)
                idx, balance = at, printed
                while held and self.waiting.containsKey((idx + 1,)):
                    amount, printed = self.waiting.getValue((idx + 1,))
                    self.waiting.removeKey((idx + 1,))
                    yield self._check(key, idx + 1, amount, printed, balance)
                    idx, balance = idx + 1, printed
            for at, row in ahead.items():
                self.waiting.updateValue((at,), row)
            held = held or bool(ahead)
        if (idx, balance) != reached:
            self.last.update((idx, balance))
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(int(timer))
            if self.waiting.exists():
                self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs()) + self.patience_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        idx, balance = self._reached()
        for at in sorted(int(k[0]) for k in self.waiting.keys()):
            amount, printed = self.waiting.getValue((at,))
            yield self._check(key, at, amount, printed, balance)
            idx, balance = at, printed
        self.waiting.clear()
        self.last.update((idx, balance))

    def close(self) -> None:
        pass


def incremental_chain(rows: DataFrame, first: int = 1, patience_ms: int | None = None) -> DataFrame:
    """W1 over a stream of rows(doc_id, idx, amount_cents, balance_cents); idx numbers an account's rows from `first` on without gaps.

    A row is given out once, as soon as the one before it has come; rows that come too early wait, and one that comes late lets go what waits
    for it. So any order of arrival ends in the rows of the batch rule. A row that repeats an earlier number is given out unchecked with late = true
    (which of several that arrive together counts is open). patience_ms: an account that got no rows for that long stops waiting for missing
    ones: what waits is checked against the row before it, as the batch rule does over a gap, and missing rows that come after all are late.
    Without patience they wait for ever. State is one row for each account and the rows that wait; no list of an account is read or written as
    a whole. Needs the RocksDB state store (see state_store)."""
    keeper = ChainKeeper(first, patience_ms)
    return rows.groupBy("doc_id").transformWithState(keeper, CHECKED, "append", "none" if patience_ms is None else "processingtime")


class state_store:
    """The RocksDB state store for queries that are started within; the session's own setting comes back after."""

    KEY, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, self.STORE)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.KEY, self.before) if self.before else self.spark.conf.unset(self.KEY)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream over present files gives, written below folder and read back."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files as they land: (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def ingest(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of files to handle(batch, number), in the order of arrival; a batch that fails is handed over again."""
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
