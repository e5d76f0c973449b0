"""Sessions: begun, appended to under optimistic numbering, ended, completed, and expired when idle; as a stream and over a whole log.

Both forms follow the same rules, in the order of seq within a session (ties by kind, then expected, then data):

- begin opens a session that is not there yet; with ``implicit``, the first operation of any kind opens it;
- append is accepted if expected is null or the next number, and gets that number; else it is a conflict;
- end closes an open session, complete an ended or expired one;
- an open session whose last operation is more than ``idle`` seconds old is expired: one row of kind expire says so, and what comes
  later meets an ended session.

Each operation gets a status (accepted, conflict, rejected) and, if it isn't accepted, a reason. Operations without a session are
left out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FATE = "session string, operation long, kind string, data string, status string, reason string"
_STATE = "phase string, last long, at double"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(ops: DataFrame) -> DataFrame:
    """ops(session, kind[, seq, at, expected, data]) with all columns: seq is expected if there is none, at seconds."""
    have = lambda c, kind: F.col(c).cast(kind) if c in ops.columns else F.lit(None).cast(kind)
    seq = have("seq" if "seq" in ops.columns else "expected", "long")
    at = F.col("at").cast("double") if "at" in ops.columns else F.lit(None).cast("double")
    time = [F.col("at").alias("event_time")] if "at" in ops.columns else []
    return ops.where("session IS NOT NULL").select(F.col("session").cast("string").alias("session"), seq.alias("seq"), at.alias("at"), "kind", have("expected", "long").alias("expected"), have("data", "string").alias("data"), *time)


class Sessions(StatefulProcessor):
    """The state of a session is its phase, its last number and the time of its last operation, whatever its length."""

    def __init__(self, idle: float | None, implicit: bool) -> None:
        self.idle, self.implicit = idle, implicit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        phase, last, seen = self.state.get() if self.state.exists() else (None, 0, None)
        order = lambda r: (r.seq is not None, r.seq or 0, r.kind or "", r.expected is not None, r.expected or 0, r.data is not None, r.data or "")
        for r in sorted(rows, key=order):
            if phase == "open" and self.idle is not None and None not in (seen, r.at) and r.at - seen > self.idle:
                phase = "expired"
                yield self._row(key, None, "expire", None, "accepted", None)
            number, status, reason, phase = self._step(r, phase or ("open" if self.implicit else None), last)
            last = number or last
            seen = r.at if seen is None or (r.at is not None and r.at > seen) else seen
            yield self._row(key, number, r.kind, r.data, status, reason)
        self.state.update((phase, last, seen))
        for timer in list(self.handle.listTimers()) if self.idle is not None else ():
            self.handle.deleteTimer(timer)
        if phase == "open" and self.idle is not None and seen is not None:
            self.handle.registerTimer(int((seen + self.idle) * 1000) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        phase, last, seen = self.state.get() if self.state.exists() else (None, 0, None)
        if phase == "open":
            self.state.update(("expired", last, seen))
            yield self._row(key, None, "expire", None, "accepted", None)

    @staticmethod
    def _row(key: tuple, number: int | None, kind: str | None, data: str | None, status: str, reason: str | None) -> Row:
        return Row(session=key[0], operation=number, kind=kind, data=data, status=status, reason=reason)

    @staticmethod
    def _step(r: Row, phase: str | None, last: int) -> tuple[int | None, str, str | None, str | None]:
        """(number, status, reason, phase after) of an operation."""
        if r.kind == "begin":
            return (None, "accepted", None, "open") if phase is None else (None, "rejected", "already begun", phase)
        if phase is None:
            return None, "rejected", "not found", None
        if r.kind == "append" and phase == "open":
            fits = r.expected is None or r.expected == last + 1
            return (last + 1, "accepted", None, phase) if fits else (None, "conflict", f"next is {last + 1}", phase)
        if r.kind in ("append", "end"):
            return (None, "accepted", None, "ended") if phase == "open" else (None, "rejected", "already ended", phase)
        if r.kind == "complete":
            fates = {"open": ("rejected", "not ended", phase), "complete": ("rejected", "already completed", phase)}
            return None, *fates.get(phase, ("accepted", None, "complete"))
        return None, "rejected", "unknown kind", phase


def session_stream(ops: DataFrame, idle: float | None = None, implicit: bool = True, delay: str = "1 minute") -> DataFrame:
    """A stream of ops with their fates. idle needs a time column at: sessions expire by event time, delay is the watermark.

    Stateful processors need the RocksDB state store; the session's setting is changed to it if it names another.
    """
    spark, name = ops.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, None) != _PROVIDER:
        spark.conf.set(name, _PROVIDER)
    if idle is not None and "at" not in ops.columns:
        raise ValueError("sessions expire by the time in column at, which is missing")
    rows = _ordered(ops)
    timed = idle is not None
    rows = rows.withWatermark("event_time", delay) if timed else rows.drop("event_time")
    return rows.groupBy("session").transformWithState(Sessions(idle, implicit), FATE, "Append", "EventTime" if timed else "None")


def session_fates(ops: DataFrame, idle: float | None = None, implicit: bool = True, now: float | None = None) -> DataFrame:
    """The fates of a whole log at once: what session_stream() gives for it, with now (seconds) as its watermark at the end.

    A session is one fold over its sorted operations, in the JVM; its size is that of its own operations.
    """
    op = F.struct(F.col("seq").isNotNull().alias("k"), F.coalesce("seq", F.lit(0)).alias("s"), F.coalesce("kind", F.lit("")).alias("kind"), "expected", "data", "at")
    rows = _ordered(ops).groupBy("session").agg(F.sort_array(F.collect_list(op)).alias("ops"))
    kind = "struct<operation: bigint, kind: string, data: string, status: string, reason: string>"
    first = F.expr(f"named_struct('phase', {repr('open') if implicit else 'CAST(NULL AS STRING)'}, 'last', 0L, 'at', CAST(NULL AS DOUBLE), 'out', CAST(array() AS array<{kind}>))")
    expired = "CAST(named_struct('operation', CAST(NULL AS BIGINT), 'kind', 'expire', 'data', CAST(NULL AS STRING), 'status', 'accepted', 'reason', CAST(NULL AS STRING)) AS " + kind + ")"

    def step(acc, x):
        late = (acc.phase == "open") & (x["at"] - acc["at"] > F.lit(idle)) if idle is not None else F.lit(False)
        late = F.coalesce(late, F.lit(False)) & (F.lit(not implicit) | acc["at"].isNotNull())
        phase = F.when(late, F.lit("expired")).otherwise(acc.phase)
        begin, append, end, complete = (x.kind == k for k in ("begin", "append", "end", "complete"))
        open_ = F.coalesce(phase == "open", F.lit(False))
        fits = x.expected.isNull() | (x.expected == acc.last + 1)
        opens = begin & phase.isNull()
        reason = (
            F.when(opens, None).when(begin, F.lit("already begun")).when(phase.isNull(), F.lit("not found"))
            .when(append & open_ & ~fits, F.concat(F.lit("next is "), (acc.last + 1).cast("string"))).when((append | end) & ~open_, F.lit("already ended"))
            .when(complete & open_, F.lit("not ended")).when(complete & (phase == "complete"), F.lit("already completed")).when(~(append | end | complete), F.lit("unknown kind"))
        )
        good = reason.isNull()
        number = F.when(append & good, acc.last + 1)
        status = F.when(good, F.lit("accepted")).when(append & open_, F.lit("conflict")).otherwise(F.lit("rejected"))
        after = F.when(~good, phase).when(begin, F.lit("open")).when(end, F.lit("ended")).when(complete, F.lit("complete")).otherwise(phase)
        row = F.struct(number.alias("operation"), F.nullif(x.kind, F.lit("")).alias("kind"), x.data.alias("data"), status.alias("status"), reason.alias("reason")).cast(kind)
        out = F.concat(acc.out, F.when(late, F.array(F.expr(expired))).otherwise(F.expr(f"CAST(array() AS array<{kind}>)")), F.array(row))
        return F.struct(after.alias("phase"), F.coalesce(number, acc.last).alias("last"), F.greatest(acc["at"], x["at"]).alias("at"), out.alias("out"))

    ends = F.expr(f"CAST(array() AS array<{kind}>)")
    if idle is not None and now is not None:
        ends = F.when((F.col("x.phase") == "open") & (F.lit(now) - F.col("x.at") > F.lit(idle)), F.array(F.expr(expired))).otherwise(ends)
    folded = rows.select("session", F.aggregate("ops", first, step).alias("x"))
    return folded.select("session", F.explode(F.concat("x.out", ends)).alias("r")).select("session", "r.*")
