"""The late-arrival guard as a stream: a keyed operator that keeps the winner of each key.

Writes of one (subject, predicate) come in any order. The log is read by the order of its writes, so a late one would stand
in for a newer value. The guard passes every write on, then writes the winner once more where the last write isn't it: the
last write of what comes out is always what the batch rule, the greatest (valid_from, seq), says. Its state is a row a key,
in RocksDB, so that it is as large as the number of keys and survives restarts with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WRITTEN = "seq long, place int, op string, subject long, predicate string, object string, valid_from long, valid_to long, kind string, n long"
KEPT = "won_at long, won_seq long, won_op string, won_object string, won_to long, head_seq long, head_place int, head_op string, head_object string, head_to long"


def state_in_rocksdb(spark: SparkSession) -> None:
    """Keyed state is kept in RocksDB from now on; queries that began otherwise go on as they began."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Guard(StatefulProcessor):
    """Of each key: writes as they come, at most one repair a micro-batch, and how many writes said nothing new.

    A write that equals the winner in instant, value and end is a repeat: it is counted, not passed on, and lends the winner
    its order. A repair has the order of the write that it follows, one place further. An older write of the winner's own
    value needs none. Unset instants are 0. Rows of a micro-batch are taken one by one, whatever their number or order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        won, head, repeats = None, None, 0
        if self.kept.exists():
            kept = tuple(self.kept.get())
            won, head = kept[:5], kept[5:]
        for r in rows:
            at, said = r.valid_from or 0, (r.op, r.object, r.valid_to)
            if won and (at, *said) == (won[0], *won[2:]):
                won = (at, max(r.seq, won[1]), *said)
                repeats += 1
                continue
            if not won or (at, r.seq) > won[:2]:
                won = (at, r.seq, *said)
            if not head or (r.seq, 0) > head[:2]:
                head = (r.seq, 0, *said)
            yield self._row(key, r.seq, 0, said, r.valid_from, "write", 1)
        if won[2:] != head[2:]:
            head = (head[0], head[1] + 1, *won[2:])
            yield self._row(key, *head[:2], won[2:], won[0], "repair", 1)
        if repeats:
            yield self._row(key, won[1], -1, (None, None, None), None, "suppressed", repeats)
        self.kept.update((*won, *head))

    def _row(self, key: tuple, seq: int, place: int, said: tuple, at: int | None, kind: str, n: int) -> Row:
        op, obj, to = said
        return Row(seq=seq, place=place, op=op, subject=key[0], predicate=key[1], object=obj, valid_from=at, valid_to=to, kind=kind, n=n)

    def close(self) -> None:
        pass


def guarded(writes: DataFrame) -> DataFrame:
    """A stream of writes (seq, op, subject, predicate, object, valid_from, valid_to) of predicates of one value as rows of
    WRITTEN: ``kind`` is ``write``, ``repair`` or ``suppressed``, of which ``n`` is the number."""
    return writes.groupBy("subject", "predicate").transformWithState(Guard(), WRITTEN, "Append", "None")


def log_of(written: DataFrame) -> DataFrame:
    """What the guard wrote as a fact log, whose raw head is the guarded head of what came in."""
    from pyspark.sql import functions as F

    return written.where("kind != 'suppressed'").select(F.struct("seq", "place").alias("seq"), "op", "subject", "predicate", "object", "valid_from", "valid_to")
