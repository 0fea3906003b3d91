"""Streams of changes: each micro-batch goes through change propagation and one run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from condnet.common import children, remove, scope
from condnet.operators.apps import Orchestrator, State, change_flows


class Controller:
    """Keeps the state from batch to batch in a folder that all executors share, and hands it to a sink after each.

    Each batch's state is written under its number, its last file last; a controller that starts on a folder goes on from the newest
    complete one, and only that and the one before it are kept.
    """

    def __init__(self, state: State, apps: Orchestrator, folder: str, sink: Callable[[State, int], None] | None = None):
        self.spark, self.apps, self.folder, self.sink = state.tp.sparkSession, apps, folder.rstrip("/"), sink
        self.state, self.done = state, -1
        for epoch in sorted(self._epochs(), reverse=True):
            if (saved := State.load(self.spark, self._at(epoch))) is not None:
                self.state, self.done = saved, epoch
                break

    def _epochs(self) -> list[int]:
        return [int(n.split("=")[1]) for n in children(self.spark, self.folder) if n.startswith("epoch=")]

    def _at(self, epoch: int) -> str:
        return f"{self.folder}/epoch={epoch}"

    def batch(self, changes: DataFrame, epoch: int) -> None:
        """changes: (seq, op I | D, fid, src, dst, vol, fw, lb), applied in order of seq. A batch that is delivered again does nothing."""
        if epoch <= self.done:
            return
        with scope():  # what the run writes on its way goes once the new state is written
            self.state = self.apps.run(change_flows(self.state, changes)).save(self._at(epoch))
        self.done = epoch
        for old in self._epochs():
            if old < epoch - 1:
                remove(self.spark, self._at(old))
        if self.sink:
            self.sink(self.state, epoch)

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """once: stop when all that is there has been read."""
        w = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()


def net_change_of_stream(log: DataFrame, folder: str) -> DataFrame:
    """What a stream of additions and deletions (seq, fid, src, dst, isadd) leaves to do per flow, once it has been read to its present end.

    Every micro-batch is reduced to one row a flow and written under its own number, so one that is delivered again replaces
    itself; the rows of all batches are merged by the same rule.
    """
    last = F.max(F.when(F.col("isadd") == 0, F.col("seq"))).alias("last_del")

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.groupBy("fid").agg(last, F.max("seq").alias("seq"), F.max_by(F.struct("src", "dst", "isadd"), "seq").alias("x")).write.mode("overwrite").parquet(f"{folder}/rows/batch={epoch}")

    q = log.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    per = log.sparkSession.read.parquet(f"{folder}/rows").groupBy("fid").agg(F.max("last_del").alias("last_del"), F.max_by("x", "seq").alias("x"))
    added = F.col("x.isadd") == 1
    return per.select("fid", F.col("last_del").isNotNull().alias("deleted"), added.alias("added"), F.when(added, F.col("x.src")).alias("src"), F.when(added, F.col("x.dst")).alias("dst"))
