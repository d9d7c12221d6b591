"""Streams that keep their own state per key, by Spark's ``transformWithState``.

State lives in Spark's state store, so the cost of a micro-batch follows its own rows and
not what came before, and a restarted query goes on where its checkpoint is.  Each
operator returns a streaming DataFrame; write it in update mode.

Before the shuffle, tasks reduce their rows to one per photo or batch.  Keys are buckets
of photos or single batches, so a job or root with a third of all events is spread over many
tasks.  The processors are defined inside functions, so executors get their code with
the query.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from photocat.operators.edits import latest_by_key
from photocat.operators.stats import tally
from photocat.schema import LABEL_COUNTS, MISSING

STARTED = "Started"
BUCKETS = 32
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(spark: SparkSession) -> None:
    """The only store with several state variables per key.  Streams that run or have a checkpoint keep theirs."""
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


def stream_batch_finished(log: DataFrame, keep_seconds: int = 3600, idle_seconds: int = 30 * 86400) -> DataFrame:
    """Batches whose last result arrived, each once.

    ``log`` carries ingest events and the ``Started`` rows with ``enqueued``, in any order.
    Processed and stale results both count.  Tasks count their own rows first, so a batch with
    very many results is one row per task at its counter.  When a batch is finished only
    that it is stays, so a start that is delivered again changes nothing; a timer removes
    this after ``keep_seconds`` without news, and an unfinished batch after ``idle_seconds``.  Timers
    follow the arrival of rows, hence no row is ever late.  Rows without a job or generation
    belong to no batch.
    """
    started = STARTED

    def counted(frames):
        for pdf in frames:
            starts = pdf["kind"] == started
            parts = pdf.assign(done=(~starts).astype("int64"), enqueued=pdf["enqueued"].where(starts).astype("Int64"))
            yield parts.groupby(["job", "generation"], as_index=False).agg(
                {"done": "sum", "enqueued": "max", "at": "max"}
            )

    class Counter(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.count = handle.getValueState("count", "done bigint, enqueued bigint, finished boolean")

        def handleInputRows(self, key, rows, timerValues):
            done, enqueued, finished = self.count.get() if self.count.exists() else (0, None, False)
            now = 0
            for pdf in rows:
                done += int(pdf["done"].sum())
                announced = pdf["enqueued"].dropna()
                if len(announced):
                    enqueued = int(announced.max())
                now = max(now, int(pdf["at"].max()))
            if not finished and enqueued is not None and done >= enqueued:
                finished = True
                yield pd.DataFrame([(*key, done, enqueued)], columns=["job", "generation", "done", "enqueued"])
            self.count.update((0, None, True) if finished else (done, enqueued, False))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + 1000 * (keep_seconds if finished else idle_seconds))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.count.clear()
            return iter([])

        def close(self):
            pass

    _use_rocksdb(log.sparkSession)
    parts = (
        log.where(F.col("job").isNotNull() & F.col("generation").isNotNull())
        .select("job", "generation", "kind", "enqueued", F.unix_millis(F.current_timestamp()).alias("at"))
        .mapInPandas(counted, "job string, generation bigint, done bigint, enqueued bigint, at bigint")
    )
    seen = parts.withColumn("seen", F.timestamp_millis("at")).withWatermark("seen", "1 second")
    return seen.groupBy("job", "generation").transformWithStateInPandas(
        Counter(), "job string, generation bigint, done bigint, enqueued bigint", "update", "EventTime"
    )


def stream_ingest_state(log: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Latest outcome per (job, photo) among results of the generation that was active.

    ``log`` carries ingest events and ``Started`` rows, whose ``event_id`` is where a generation
    begins, in any order.  A result waits until the start of its generation is known; a start that
    arrives late takes back what it shows to be stale.  A row is given out when the outcome of a
    photo changes, with a null ``kind`` if none is left; ``latest_states`` reads the last of them.

    State is one row per photo: the last valid result of generations whose successor has started, and
    all results of the others.  Generations of a job count up by one; where one is missing, its results are kept.
    Starts go to all ``buckets`` of photos.  Rows without a job, generation or event id are ignored, as
    are results without an id.

    Before the shuffle, each Arrow batch packs its starts into one row per job and its results into one per job
    and bucket, as the cost of a row is that of its way to Python and not of its values.
    """
    columns = ["generation", "event_id", "id", "kind"]
    chunk = 10_000

    def packed(batches):
        for batch in batches:
            groups = pa.Table.from_batches([batch]).group_by(["job", "_bucket"], use_threads=False)
            lists = groups.aggregate([(c, "list") for c in columns])
            yield from lists.rename_columns([c.removesuffix("_list") for c in lists.column_names]).to_batches()

    class Judge(StatefulProcessor):
        def init(self, handle):
            # Pairs of 64-bit numbers; as arrays, every number would be looked at on its way.
            self.starts = handle.getValueState("starts", "generations binary, events binary")
            self.newest = handle.getValueState("newest", "event bigint")
            self.waiting = handle.getListState(
                "waiting", "generations array<bigint>, events array<bigint>, ids array<bigint>, kinds array<string>"
            )
            self.photos = handle.getMapState(
                "photos", "id bigint",
                "generations array<bigint>, events array<bigint>, kinds array<string>, told bigint, told_kind string",
            )

        def handleInputRows(self, key, rows, timerValues):
            known, found, begun = {}, [], {}
            if self.starts.exists():
                known = dict(zip(*(np.frombuffer(b, "int64").tolist() for b in self.starts.get()), strict=True))
            newest = self.newest.get()[0] if self.newest.exists() else None
            for pdf in rows:
                for generations, events, ids, kinds in pdf[columns].itertuples(index=False, name=None):
                    if ids is None:
                        begun.update(zip(generations.tolist(), events.tolist(), strict=True))
                    else:
                        found += zip(generations.tolist(), events.tolist(), ids.tolist(), kinds, strict=True)
            seen = max([r[1] for r in found] + list(begun.values()))
            begun = {g: e for g, e in begun.items() if known.get(g) != e}
            if begun:
                known |= begun
                self.starts.update(tuple(np.array(list(v), "int64").tobytes() for v in (known, known.values())))
                for lists in self.waiting.get():
                    found += zip(*lists, strict=True)
                self.waiting.clear()
            later = [r for r in found if r[0] not in known]
            if later:
                parts = (later[i : i + chunk] for i in range(0, len(later), chunk))
                self.waiting.appendList([tuple(list(c) for c in zip(*part, strict=True)) for part in parts])
            touched = {}
            for generation, event, photo, kind in found:
                if generation in known:
                    touched.setdefault(photo, []).append((event, generation, kind))
            if newest is not None and begun and min(begun.values()) <= newest:
                stored = {photo: value for (photo,), value in self.photos.iterator()}
                touched |= {photo: [] for photo in stored if photo not in touched}
            else:
                stored = {p: self.photos.getValue((p,)) for p in touched if self.photos.containsKey((p,))}
            # Where the next generation begins; looked up by every result.
            marks = sorted(set(known.values()))
            until = dict(zip(marks, [*marks[1:], None], strict=False))
            out = []
            for photo, fresh in touched.items():
                change = self.judged(photo, stored.get(photo), fresh, known, until)
                if change:
                    out.append((key[0], photo, *change))
            if newest is None or seen > newest:
                self.newest.update((seen,))
            if out:
                pdf = pd.DataFrame(out, columns=["job", "id", "kind", "event_id"], dtype="object")
                yield pdf.astype({"id": "int64", "event_id": "Int64"})

        def judged(self, photo, stored, fresh, known, until):
            """(kind, event) if the photo's outcome changed."""
            held, told = set(), (None, None)
            if stored:
                generations, events, kinds, *last = stored
                held, told = set(zip(events, generations, kinds, strict=True)), (last[1], last[0])
            best, settled, kept = None, None, set()
            for result in held.union(fresh):
                event, generation, _ = result
                start = known[generation]
                valid = event >= start and (until[start] is None or event < until[start])
                if valid and (best is None or event > best[0]):
                    best = result
                if generation + 1 not in known:
                    kept.add(result)
                elif valid and (settled is None or event > settled[0]):
                    settled = result
            # What comes back when a late start shows the results above it to be stale.
            if settled:
                kept.add(settled)
            now = (best[2], best[0]) if best else (None, None)
            if stored is None or now != told or kept != held:
                rest = [list(c) for c in zip(*kept, strict=True)] or [[], [], []]
                self.photos.updateValue((photo,), (rest[1], rest[0], rest[2], now[1], now[0]))
            return None if now == told else now

        def close(self):
            pass

    _use_rocksdb(log.sparkSession)
    is_start = F.col("kind").eqNullSafe(STARTED)
    whole = F.col("job").isNotNull() & F.col("generation").isNotNull() & F.col("event_id").isNotNull()
    mine = F.pmod(F.hash("id"), F.lit(buckets))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    longs = [F.col(c).cast("bigint").alias(c) for c in columns[:3]]
    rows = log.where(whole & (is_start | F.col("id").isNotNull())).select(
        "job", F.when(~is_start, mine).alias("_bucket"), *longs, "kind"
    )
    packs = rows.mapInArrow(
        packed,
        "job string, _bucket int, generation array<bigint>, event_id array<bigint>, id array<bigint>, kind array<string>",
    )
    result = F.col("_bucket").isNotNull()
    spread = packs.select(
        "job", F.explode(F.when(result, F.array("_bucket")).otherwise(every)).alias("_bucket"), "generation", "event_id",
        F.when(result, F.col("id")).alias("id"), F.when(result, F.col("kind")).alias("kind"),
    )
    return spread.groupBy("job", "_bucket").transformWithStateInPandas(
        Judge(), "job string, id bigint, kind string, event_id bigint", "update", "None"
    )


def latest_states(seen: DataFrame, order: str = "batch") -> DataFrame:
    """What ``stream_ingest_state`` says at last, from its updates and their order."""
    return latest_by_key(seen, ["job", "id"], ["kind", "event_id"], [order]).where(F.col("kind").isNotNull())


def stream_tally(label_events: DataFrame, photos: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Live label counts of the roots whose photos are relabelled; a row per changed root.

    The first operator keeps the last label of every live photo, the stored one to begin with, and
    turns a relabel into one photo less under the old label and one more under the new one.  The
    second keeps the counts of every root and adds these changes.  Events of unknown or missing
    photos are ignored, as are photos without a root.  ``tally_now`` adds the roots without changes.
    """
    names = dict(LABEL_COUNTS)
    columns = ["root", *names.values(), "n_errors"]
    least = -(1 << 63)

    def last_of_photo(frames):
        for pdf in frames:
            yield pdf.sort_values(["at", "event_id"]).drop_duplicates("id", keep="last")

    class LastLabel(StatefulProcessor):
        def init(self, handle):
            self.photos = handle.getMapState("photos", "id bigint", "root string, label int, at bigint, event_id bigint")

        def handleInitialState(self, key, initialState, timerValues):
            for row in initialState.itertuples(index=False):
                label = None if pd.isna(row.label) else int(row.label)
                self.photos.updateValue((int(row.id),), (row.root, label, least, least))

        def handleInputRows(self, key, rows, timerValues):
            moves = {}
            for pdf in rows:
                for row in pdf.itertuples(index=False):
                    photo = (int(row.id),)
                    if not self.photos.containsKey(photo):
                        continue
                    root, label, at, event = self.photos.getValue(photo)
                    if (int(row.at), int(row.event_id)) <= (at, event):
                        continue
                    new = None if pd.isna(row.label) else int(row.label)
                    self.photos.updateValue(photo, (root, new, int(row.at), int(row.event_id)))
                    moves[root, label] = moves.get((root, label), 0) - 1
                    moves[root, new] = moves.get((root, new), 0) + 1
            changed = [(r, k, n) for (r, k), n in moves.items() if n and k in names]
            if changed:
                yield pd.DataFrame(changed, columns=["root", "label", "n"])

        def close(self):
            pass

    class Counts(StatefulProcessor):
        def init(self, handle):
            self.counts = handle.getValueState("counts", "n array<bigint>")

        def handleInitialState(self, key, initialState, timerValues):
            self.counts.update((initialState[columns[1:]].iloc[0].astype(int).tolist(),))

        def handleInputRows(self, key, rows, timerValues):
            n = list(self.counts.get()[0]) if self.counts.exists() else [0] * (len(columns) - 1)
            for pdf in rows:
                for label, moved in zip(pdf["label"], pdf["n"], strict=True):
                    n[columns.index(names[int(label)]) - 1] += int(moved)
            self.counts.update((n,))
            yield pd.DataFrame([(*key, *n)], columns=columns)

        def close(self):
            pass

    _use_rocksdb(label_events.sparkSession)
    bucket = F.pmod(F.hash("id"), F.lit(buckets)).alias("_bucket")
    live = photos.where((F.col("status") != MISSING) & F.col("root").isNotNull() & F.col("id").isNotNull())
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(least + 1))
    events = (
        label_events.where("id IS NOT NULL")
        .select("id", F.col("label").cast("int").alias("label"), at.alias("at"), "event_id")
        .mapInPandas(last_of_photo, "id bigint, label int, at bigint, event_id bigint")
    )
    moves = (
        events.select("*", bucket)
        .groupBy("_bucket")
        .transformWithStateInPandas(
            LastLabel(), "root string, label int, n bigint", "update", "None",
            initialState=live.select("id", "root", F.col("label").cast("int").alias("label"), bucket).groupBy("_bucket"),
        )
    )
    stored = tally(photos.where("root IS NOT NULL"))
    counted = ", ".join(f"{c} {'string' if c == 'root' else 'bigint'}" for c in columns)
    return moves.groupBy("root").transformWithStateInPandas(
        Counts(), counted, "update", "None", initialState=stored.groupBy("root")
    )


def tally_now(photos: DataFrame, seen: DataFrame, order: str = "batch") -> DataFrame:
    """Counts of every root: what ``stream_tally`` said last, the stored ones where it said nothing."""
    stored = tally(photos)
    both = stored.withColumn(order, F.lit(-1).cast("bigint")).unionByName(
        seen.select(*stored.columns, F.col(order).cast("bigint").alias(order))
    )
    return latest_by_key(both, ["root"], [c for c in stored.columns if c != "root"], [order])
