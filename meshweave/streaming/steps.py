"""Time steps on Structured Streaming: one micro-batch is one step."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshweave.plans.coupling import Session
from meshweave.plans.durable import get_text, names_in, on_store, put_text

#: Where the state of the codes stands in a stream's checkpoint, and how many of its last steps are kept.
STATE, KEPT = "meshweave-steps", 3


def last_state(spark: SparkSession, checkpoint: str) -> tuple[int, str] | None:
    """The number of the last step that ended, and what Session.saved() was then; None in a new checkpoint."""
    known = [int(x.removesuffix(".json")) for x in names_in(spark, f"{checkpoint}/{STATE}") if x.endswith(".json")]
    if not known:
        return None
    return max(known), get_text(spark, f"{checkpoint}/{STATE}/{max(known):012d}.json")


def run_steps(stream: DataFrame, session: Session, codes: str | Iterable[str], exchange: Callable[[DataFrame, int], None], checkpoint: str, time_column: str = "ts") -> StreamingQuery:
    """Open a step of every code for each micro-batch, run `exchange(batch, step)` in it and end it; the batch's last
    time is the step's.

    The number of a step is that of its batch. What the session knows (Session.saved()) is put beside the stream's own
    checkpoint when a step has ended. A query started again with the same checkpoint, in a new process too, first takes
    it over and so goes on at its step, with its times, parameters and output. A batch that failed, or that ended but
    was not yet committed, comes again under its number: its exchanges are made again, and its output takes the place
    of what was there. Without a batch of rows, no step is made.
    """
    spark, codes = stream.sparkSession, [codes] if isinstance(codes, str) else list(codes)
    known = last_state(spark, checkpoint)
    if known is not None:
        session.restored(known[1])

    def one(batch: DataFrame, batch_id: int) -> None:
        row = batch.agg(F.max(F.col(time_column).cast("timestamp").cast("double"))).first()
        begun = []
        try:
            for code in codes:
                session.step_begin(code, float(batch_id) if row[0] is None else row[0], batch_id)
                begun.append(code)
            exchange(batch, batch_id)
            for code in codes:
                session.step_end(code)
        except BaseException:
            for code in begun:
                session.step_failed(code)
            raise
        put_text(spark, f"{checkpoint}/{STATE}/{batch_id:012d}.json", session.saved())
        for name in names_in(spark, f"{checkpoint}/{STATE}")[:-KEPT]:
            store, old = on_store(spark, f"{checkpoint}/{STATE}/{name}")
            store.delete(old, False)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_step(events: DataFrame, step: str = "day") -> DataFrame:
    """(step, n, total, mean): what each step of a table of events receives, steps numbered from 0 by time."""
    at = F.date_trunc(step, "ts")
    seconds = {"day": 86_400, "hour": 3_600, "minute": 60}[step]
    first = events.agg(F.min(at).alias("first"))
    numbered = events.join(F.broadcast(first)).withColumn("step", ((F.unix_timestamp(at) - F.unix_timestamp("first")) / seconds).cast("int"))
    return numbered.groupBy("step").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def by_week(events: DataFrame) -> DataFrame:
    """(step, gnum, value): the sum of each user's events in each week, weeks numbered from 0 by time."""
    at = F.date_trunc("week", "ts")
    first = events.agg(F.min(at).alias("first"))
    step = F.floor(F.datediff(at, F.col("first")) / 7).cast("int")
    return events.join(F.broadcast(first)).groupBy(step.alias("step"), F.col("user_id").alias("gnum")).agg(F.sum("value").alias("value"))
