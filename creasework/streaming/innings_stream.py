"""Running scores over a stream of balls: what ``balls.with_context`` gives, ball by ball, with state per slot of innings.

A ball waits until the watermark has passed its time, so whatever order balls arrive in within the watermark, they are
counted in the order of their numbers; then it goes out with its score and leaves the state. An innings without a ball for
``pause`` is closed and its score leaves the state. Innings are dealt by a hash over ``SLOTS`` keys, and these over the
shuffle's partitions: a slot's balls are scored together, with a few calls to the state for all its innings. A task holds
the waiting balls of one slot at a time, one of ``SLOTS`` parts of all.

Assumed: within an innings a later number has no earlier time, and no pause is as long as ``pause``. Defined cases: a ball
that comes again while it waits counts once, one whose number the score has passed is left out (it has been counted, or
its time was wrong); balls behind the watermark are left out and counted in the query's ``numRowsDroppedByWatermark``.
Null runs count as none. Balls without innings, number or time never get a score and are left out. The last balls of a
stream go out when later ones, of any innings, move the watermark on. The watermark ends at ``FAR``, as pandas holds no
later times: once it is near that, within ``late`` or a little more, later balls go out as soon as they come.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from creasework.operators import balls

#: Timers need a state store with column families.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that innings are dealt over; the state lies by them, so a checkpoint is of no use after a change.
SLOTS = 2048
#: The last time of a watermark.
FAR = "2262-04-10 00:00:00"
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Of an over: its last number and time, runs and legal balls so far. A ball counts as one more of these.
_OVER = pa.schema([("innings", pa.string()), *((c, pa.int64()) for c in ("over_number", "ball_number", "at_ms", "runs", "legal"))])
_BALL = _OVER.append(pa.field("ball", pa.string()))
#: Rows in an entry of the state.
_PIECE = 50_000


def _packed(table: pa.Table) -> list[tuple[bytes]]:
    """Rows as entries of the state."""
    out = []
    for i in range(0, len(table), _PIECE):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as writer:
            writer.write_table(table.slice(i, _PIECE))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(entries: Iterable[tuple[bytes]], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(e).read_all() for (e,) in entries)])


def _parsed(lines: pd.Series) -> pa.Table:
    """Balls from lines; JSON holds no raw tabs and newlines."""
    text = "\n".join(lines).encode()
    return csv.read_csv(
        pa.BufferReader(text),
        csv.ReadOptions(use_threads=False, block_size=len(text) + 1, column_names=_BALL.names),
        csv.ParseOptions(delimiter="\t", quote_char=False),
        csv.ConvertOptions(column_types=_BALL, strings_can_be_null=False),
    )


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys, which stand together, begin."""
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _so_far(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Running sums within groups."""
    total = np.cumsum(values)
    return total - np.repeat((total - values)[firsts], np.diff(np.r_[firsts, len(values)]))


class Score(StatefulProcessor):
    """Balls of the innings of a slot in the order of their numbers, with runs and legal balls so far."""

    def __init__(self, pause_ms: int, far_ms: int):
        self.pause_ms, self.far_ms = pause_ms, far_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Balls in the order in which they came.
        self.waiting = handle.getListState("waiting", "balls binary")
        #: Overs of the innings that aren't closed.
        self.score = handle.getListState("score", "overs binary")
        #: The time of the slot's only timer.
        self.due = handle.getValueState("due", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came, overs = pa.concat_tables([_parsed(d["line"]) for d in rows]), _unpacked(self.score.get(), _OVER).to_pandas()
        if len(overs):
            last = came["innings"].to_pandas().map(overs.groupby("innings")["ball_number"].max())
            came = came.filter(pa.array(~(came["ball_number"].to_pandas() <= last)))
        if len(came):
            self.waiting.appendList(_packed(came))
            first, due = min(int(came["at_ms"].to_numpy().min()), self.far_ms), self.due.get()
            if due is None or first < due[0]:
                if due is not None:
                    self.handle.deleteTimer(due[0])
                self.handle.registerTimer(first)
                self.due.update((first,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        overs, held = _unpacked(self.score.get(), _OVER), _unpacked(self.waiting.get(), _BALL)
        both = pa.concat_tables([overs, held.select(_OVER.names)])
        names = both["innings"].combine_chunks().dictionary_encode()
        innings, is_ball = names.indices.to_numpy(), np.arange(len(both)) >= len(overs)
        over, number, at, runs, legal = (both[c].to_numpy() for c in _OVER.names[1:])
        # by innings, what is counted before the balls, these by number; of one number the first that came
        order = np.lexsort((number, is_ball, innings))
        again = np.r_[False, (np.diff(innings[order]) == 0) & (np.diff(number[order]) == 0) & is_ball[order][:-1]]
        waits = is_ball[order] & (np.minimum(at[order], self.far_ms) > now)
        later, ready = order[waits & ~again], order[~waits & ~again]
        begins = _firsts(innings[ready])
        cum_runs, cum_legal = _so_far(runs[ready], begins), _so_far(legal[ready], begins)
        by_over = np.lexsort((over[ready], innings[ready]))
        grouped, in_over = ready[by_over], np.empty(len(ready), "int64")
        begins = _firsts(innings[grouped], over[grouped])
        in_over[by_over] = _so_far(legal[grouped], begins)
        goes = is_ball[ready]
        out = pd.DataFrame({"ball": held["ball"].take(ready[goes] - len(overs)).to_pandas(), "cum_runs": cum_runs[goes], "cum_legal": cum_legal[goes], "ball_in_over": np.where(legal[ready] > 0, in_over, 0)[goes]})

        last = np.full(len(names.dictionary), np.iinfo("int64").min)
        np.maximum.at(last, innings[ready], at[ready])
        is_open = last > now - self.pause_ms
        is_open[innings[later]] = True
        of, made = grouped[begins], [np.maximum.reduceat(number[grouped], begins), np.maximum.reduceat(at[grouped], begins), np.add.reduceat(runs[grouped], begins), np.add.reduceat(legal[grouped], begins)]
        kept = pa.table([names.dictionary.take(innings[of]), over[of], *made], schema=_OVER).filter(is_open[innings[of]])
        self.waiting.put(_packed(held.take(later - len(overs)))) if len(later) else self.waiting.clear()
        self.score.put(_packed(kept)) if len(kept) else self.score.clear()
        ahead = np.r_[np.minimum(at[later], self.far_ms), last[last > now - self.pause_ms] + self.pause_ms]
        if len(ahead):
            self.handle.registerTimer(int(ahead.min()))
            self.due.update((int(ahead.min()),))
        else:
            self.due.clear()
        return iter([out] if len(out) else [])


def scores(deliveries: DataFrame, time: str, late: str = "10 minutes", pause_seconds: int = 6 * 3600) -> DataFrame:
    """A stream of balls with flags (``balls.with_flags``) and running scores and rates of a chase.

    ``time`` is the column with a ball's time, ``late`` how far behind the latest a ball may arrive. The session's state
    store must be RocksDB.
    """
    if deliveries.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    given = deliveries.schema
    far = F.lit(FAR).cast(given[time].dataType)
    # the watermark gets there, whatever a day and a month are
    far_ms = deliveries.sparkSession.sql("select unix_millis(cast(:far as timestamp) - 2 * cast(:late as interval) - interval 2 days)", {"far": FAR, "late": late}).first()[0]
    d = deliveries.where(f"`{time}` is not null and innings_id is not null and ball_number is not null")
    d = d.withColumn("_time", F.least(F.col(time), far)).withWatermark("_time", late)
    # in the state times are numbers and names are short
    is_time = {f.name: isinstance(f.dataType, T.TimestampType) for f in given}
    short = T.StructType([T.StructField(str(i), T.LongType() if is_time[f.name] else f.dataType) for i, f in enumerate(given)])
    json = F.to_json(F.struct(*((F.unix_micros(f.name) if is_time[f.name] else F.col(f.name)).alias(str(i)) for i, f in enumerate(given))), _MICROS)
    # a line a ball, as PySpark takes rows apart value by value; a null over is one of its own, below all integers
    line = F.concat_ws(
        "\t",
        F.to_json(F.array(F.col("innings_id").cast("string"))),
        F.coalesce(F.col("over_number").cast("int").cast("long"), F.lit(-(2**40))),
        F.col("ball_number").cast("long"),
        F.ceil(F.unix_micros(F.col(time).cast("timestamp")) / 1000).cast("long"),
        F.coalesce(F.col("total_runs").cast("long"), F.lit(0)),
        F.coalesce("is_legal", F.lit(False)).cast("long"),
        json,
    )
    moved = d.select(F.pmod(F.xxhash64("innings_id"), F.lit(SLOTS)).alias("slot"), line.alias("line"), "_time")
    out = moved.groupBy("slot").transformWithStateInPandas(Score(pause_seconds * 1000, far_ms), "ball string, cum_runs long, cum_legal long, ball_in_over long", "append", "EventTime")
    ball = [(F.timestamp_micros(f"ball.{i}") if is_time[f.name] else F.col(f"ball.{i}")).alias(f.name) for i, f in enumerate(given)]
    return balls.with_rates(out.withColumn("ball", F.from_json("ball", short, _MICROS)).select(*ball, "cum_runs", "cum_legal", "ball_in_over"))


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside this one, with the same partitions and zone, whose state store has timers."""
    other = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(name, spark.conf.get(name))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return other


def score_table(spark: SparkSession, source: str, target: str, checkpoint: str, time: str, late: str = "10 minutes", pause_seconds: int = 6 * 3600, files_per_trigger: int = 500) -> StreamingQuery:
    """Append scores of the balls that came to the Parquet folder ``source`` since the last call to that at ``target``."""
    other = stateful_session(spark)
    new = other.readStream.schema(other.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return scores(new, time, late, pause_seconds).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
