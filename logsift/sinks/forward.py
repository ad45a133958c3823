"""Forwarding events to another system over a sender the caller gives."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from logsift.fixed import FORWARD_BACKOFF_SECONDS, FORWARD_OK, FORWARD_PERMANENT, FORWARD_RETRIES

Sender = Callable[[Any], int]


def deliver(sender: Sender, payload: Any, retries: int = FORWARD_RETRIES, backoff: float = FORWARD_BACKOFF_SECONDS,
            sleep: Callable[[float], None] = time.sleep) -> tuple[bool, int]:
    """(delivered, calls). Overload, server errors and exceptions are tried again; any other status is final."""
    return attempt(sender, payload, retries, backoff, sleep)[:2]


def attempt(sender: Sender, payload: Any, retries: int, backoff: float, sleep: Callable[[float], None] = time.sleep) -> tuple[bool, int, bool]:
    """As `deliver`, and whether all attempts are used up without a final answer."""
    for n in range(1, retries + 2):
        try:
            status = sender(payload)
        except Exception:
            status = 500
        if status in FORWARD_OK:
            return True, n, False
        if status in FORWARD_PERMANENT or not (status == 429 or status >= 500):
            return False, n, False
        if n <= retries:
            sleep(backoff * n)
    return False, retries + 1, True


def send_all(bodies: list[str], sender: Sender, broken: Breaker, retries: int, backoff: float) -> list[tuple[bool, int]]:
    """(delivered, calls) of each body: all in one call, one by one where that fails, none while the breaker is open.

    Where a whole batch has used up its attempts, one body is sent once: if that fails as well, the receiver is down.
    """
    if broken.open:
        return [(False, 0)] * len(bodies)
    good, calls, spent = attempt(sender, bodies, retries, backoff)
    if good:
        return [(True, calls)] * len(bodies)
    if spent and broken.after is not None and bodies and attempt(sender, bodies[0], 0, backoff)[2]:
        broken.open = True
        return [(False, calls + 1)] + [(False, calls)] * (len(bodies) - 1)
    out = []
    for body in bodies:
        if broken.open:
            out.append((False, 0))
            continue
        good, calls, spent = attempt(sender, body, retries, backoff)
        out.append((good, calls))
        broken.failed(spent)
    return out


@dataclass
class Breaker:
    """Stops a task's sends once `after` single sends have used up their attempts; None never does."""

    after: int | None = None
    spent: int = 0
    open: bool = False

    def failed(self, spent: bool) -> None:
        self.spent += spent
        self.open = self.open or (self.after is not None and self.spent >= self.after)


def payloads_of(events: DataFrame) -> DataFrame:
    """(event_id, body): each row as JSON text."""
    return events.select("event_id", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("body"))


def forward(payloads: DataFrame, sender: Sender, batch_rows: int = 500, retries: int = FORWARD_RETRIES,
            backoff: float = FORWARD_BACKOFF_SECONDS, breaker: int | None = None) -> DataFrame:
    """(event_id, delivered, calls): send the rows in batches, and one by one where a batch fails.

    `payloads` has event_id; each row is sent as JSON text. Batches are cut inside a partition, so a
    task holds one batch at a time. Sending happens when the result is computed: write it once. A
    lost task is run again, so the receiver may see an event twice; it can tell by event_id. With a
    receiver that is down every row waits out its attempts, unless `breaker` names the number of rows
    after which a task stops sending; the rest is then not delivered, with no calls.
    """
    rows = payloads_of(payloads)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = Breaker(breaker)
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                part = frame.iloc[start:start + batch_rows]
                done = send_all(part["body"].tolist(), sender, broken, retries, backoff)
                yield pd.DataFrame({"event_id": part["event_id"].values, "delivered": [d for d, _ in done], "calls": [c for _, c in done]})

    return rows.mapInPandas(send, "event_id string, delivered boolean, calls int")


ASIDE = "_aside"  # where receipts are until all tasks have ended; one write to a folder at a time
RECEIPT = pa.schema([("event_id", pa.string()), ("delivered", pa.bool_()), ("calls", pa.int32())])


@dataclass
class Sent(WriterCommitMessage):
    """What one task has sent: its file of receipts, and the numbers in it."""

    file: str
    delivered: int
    undelivered: int


class _Forwarding:
    """Sends (event_id, body) and leaves a receipt of each row: aside while tasks run, in its place once all have ended."""

    def __init__(self, folder: str, sender: Sender, batch_rows: int, retries: int, backoff: float, breaker: int | None) -> None:
        self.folder, self.sender, self.batch_rows, self.retries, self.backoff, self.breaker = folder, sender, batch_rows, retries, backoff, breaker

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pafs.LocalFileSystem(), self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        fs, root = self._fs()
        aside = posixpath.join(root, ASIDE)
        fs.create_dir(aside)
        name, broken, sent = f"part-{uuid.uuid4().hex}.parquet", Breaker(self.breaker), [0, 0]
        with fs.open_output_stream(posixpath.join(aside, name)) as out, pq.ParquetWriter(out, RECEIPT) as receipts:
            for batch in iterator:
                for start in range(0, batch.num_rows, self.batch_rows):
                    part = batch.slice(start, self.batch_rows)
                    done = send_all(part.column("body").to_pylist(), self.sender, broken, self.retries, self.backoff)
                    good = sum(d for d, _ in done)
                    sent = [sent[0] + good, sent[1] + len(done) - good]
                    receipts.write_batch(pa.RecordBatch.from_arrays([part.column("event_id").cast(pa.string()), pa.array([d for d, _ in done], pa.bool_()), pa.array([c for _, c in done], pa.int32())], schema=RECEIPT))
        return Sent(name, *sent)

    def keep(self, messages: list[Sent | None], place: str) -> None:
        """Only the receipts of tasks that count; those of attempts that were lost or beaten go."""
        fs, root = self._fs()
        aside, to = posixpath.join(root, ASIDE), posixpath.join(root, place)
        if fs.get_file_info(to).type != pafs.FileType.NotFound:
            fs.delete_dir(to)  # a batch that is run again
        fs.create_dir(to)
        for message in messages:
            if message is not None:
                fs.move(posixpath.join(aside, message.file), posixpath.join(to, message.file))
        self.drop()

    def drop(self) -> None:
        fs, root = self._fs()
        aside = posixpath.join(root, ASIDE)
        if fs.get_file_info(aside).type != pafs.FileType.NotFound:
            fs.delete_dir(aside)


class _BatchWriter(_Forwarding, DataSourceArrowWriter):
    def commit(self, messages: list[Sent | None]) -> None:
        self.keep(messages, f"sent-{uuid.uuid4().hex}")

    def abort(self, messages: list[Sent | None]) -> None:
        self.drop()


class _StreamWriter(_Forwarding, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        self.keep(messages, f"sent-{batchId:012d}")

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        self.drop()


def register_forward(spark: SparkSession, name: str, sender: Sender, batch_rows: int = 500, retries: int = FORWARD_RETRIES,
                     backoff: float = FORWARD_BACKOFF_SECONDS, breaker: int | None = 1) -> None:
    """Let `df.write.format(name)` and `writeStream.format(name)` send what `payloads_of` gives; the option `receipts` names a folder.

    The receipts (event_id, delivered, calls) are there once all tasks have ended, one folder for each write or micro-batch.
    A receiver that is down costs a task one cycle of attempts and one more call; its other rows are marked as undelivered.
    """
    class Forward(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "event_id string, body string"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            return _BatchWriter(self.options["receipts"], sender, batch_rows, retries, backoff, breaker)

        def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
            return _StreamWriter(self.options["receipts"], sender, batch_rows, retries, backoff, breaker)

    spark.dataSource.register(Forward)


def read_receipts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("event_id string, delivered boolean, calls int").option("recursiveFileLookup", "true").parquet(folder)
