"""A learning loop as a stream with arbitrary state: what was seen, a short queue and counters for each learner, and sessions that end by a timer."""

from __future__ import annotations

from bisect import bisect_left
from datetime import datetime, timezone
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from loomtext.session import carried

PAGE = "learner string, pos bigint, at timestamp, topics array<string>"
STEP = "kind string, learner string, pos bigint, at timestamp, topic string, entered bigint, waiting bigint, pages bigint, topics bigint"
#: Runs of marks that are kept apart, beyond which they become one.
RUNS = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at: datetime) -> int:
    """Milliseconds of a time as workers get it: naive times are local ones."""
    return round(at.timestamp() * 1000)


def _mark(topic: str) -> int:
    """64 bits of a topic, the same in every process."""
    return int.from_bytes(blake2b(topic.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Learner(StatefulProcessor):
    """One learner's session, page by page.

    ``known`` has the topics of all sessions that were explored, whole and in lower case; ``marks`` 64 bits of each, a run of them for each batch, which are
    read once a batch so that ``known`` is asked only for what it probably has; ``met`` the keys that entered the queue in the session that is open;
    ``queue`` and ``session`` (its end and counters) are read and written once a batch.  Every call of a state goes to the JVM and back, so what begins and
    ends within a batch stays in the worker: sessions, their keys (no more than the queue and the session's pages) and their timers.  Of what was seen
    a worker holds 8 bytes a topic, and none is looked up while the queue is full.
    """

    def __init__(self, hours: float, cap: int, key_chars: int, min_chars: int):
        self.length, self.cap, self.key_chars, self.min_chars = round(hours * 3_600_000), cap, key_chars, min_chars

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "topic string", "seen boolean")
        self.marks = handle.getListState("marks", "run binary")
        self.met = handle.getMapState("met", "key string", "seen boolean")
        self.queue = handle.getListState("queue", "topic string")
        self.session = handle.getValueState("session", "until bigint, entered bigint, pages bigint, topics bigint")

    def close(self) -> None:
        pass

    def _ended(self, learner: str, session: list[int], waiting: int) -> Row:
        """The summary of a session; what it left in the queue may enter again in a later one."""
        until, entered, pages, topics = session
        at = datetime.fromtimestamp(until / 1000, timezone.utc)
        return Row(kind="session", learner=learner, pos=None, at=at, topic=None, entered=entered, waiting=waiting, pages=pages, topics=topics)

    def handleInputRows(self, key, rows, timerValues):
        queue = [r[0] for r in self.queue.get()] if self.queue.exists() else []
        session = list(self.session.get()) if self.session.exists() else None
        stored = session  # the session whose keys and timer are in the state
        runs = [bytes(r[0]) for r in self.marks.get()] if self.marks.exists() else []
        marks = np.sort(np.frombuffer(b"".join(runs), "<u8"))
        met: set[str] = set()
        explored: set[str] = set()

        def is_known(k: str) -> bool:
            if k in explored:
                return True
            mark = _mark(k)
            at = bisect_left(marks, mark)
            return at < len(marks) and int(marks[at]) == mark and self.known.containsKey((k,))

        def enter(topics: list[str | None]) -> int:
            entered = 0
            for topic in topics:
                if len(queue) >= self.cap:
                    break
                topic = (topic or "").strip()
                k = topic.lower()[: self.key_chars]
                if len(topic) < self.min_chars or k in met or is_known(k) or (session is stored and self.met.containsKey((k,))):
                    continue
                queue.append(topic)
                met.add(k)
                entered += 1
            return entered

        for page in sorted(rows, key=lambda r: (r["at"], r["pos"])):
            now = _ms(page["at"])
            if session and now >= session[0]:
                yield self._ended(key[0], session, len(queue))
                queue, session = [], None
                met.clear()
            if session is None:
                session = [now + self.length, 0, 0, 0]
            topic = queue.pop(0) if queue else None
            if topic is not None:
                explored.add(topic.lower())
                session[3] += 1
            entered = enter(page["topics"] or [])
            session[1] += entered
            session[2] += 1
            yield Row(kind="page", learner=key[0], pos=page["pos"], at=page["at"], topic=topic, entered=entered, waiting=len(queue), pages=session[2], topics=session[3])
        if session is not stored:
            if stored:
                self.handle.deleteTimer(stored[0])
                self.met.clear()
            if session:
                self.handle.registerTimer(session[0])
        for k in met:
            self.met.updateValue((k,), (True,))
        self._remember(explored, runs)
        self._keep(queue, session)

    def _remember(self, explored: set[str], runs: list[bytes]) -> None:
        if not explored:
            return
        for topic in explored:
            self.known.updateValue((topic,), (True,))
        run = b"".join(_mark(t).to_bytes(8, "little") for t in sorted(explored))
        if len(runs) < RUNS:
            self.marks.appendValue((run,))
        else:
            self.marks.put([(b"".join([*runs, run]),)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        session = list(self.session.get()) if self.session.exists() else None
        if session and session[0] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._ended(key[0], session, sum(1 for _ in self.queue.get()) if self.queue.exists() else 0)
            self.met.clear()
            self._keep([], None)

    def _keep(self, queue: list[str], session: list[int] | None) -> None:
        if queue:
            self.queue.put([(t,) for t in queue])
        else:
            self.queue.clear()
        if session:
            self.session.update(tuple(session))
        else:
            self.session.clear()


def sentences(text: Column) -> Column:
    """The topics that a text offers: what stands between its full stops, question marks and line ends."""
    return F.split(text, r"[.!?\n]")


def learning(pages: DataFrame, hours: float = 1.0, cap: int = 80, key_chars: int = 80, min_chars: int = 5, lateness: str = "1 minute") -> DataFrame:
    """The steps of every learner over a stream of pages (learner, pos, at, topics), in order of (at, pos).

    Each page takes the oldest topic from its learner's queue (null from an empty one) and offers its own: a topic enters if it has ``min_chars`` characters
    without the space around it, if the queue holds fewer than ``cap``, and if its key (lower case, ``key_chars`` characters) neither entered in this
    session nor is a topic that was explored in any.  As explored topics are known whole, a longer one may come again in a later session.  A session lasts
    ``hours`` from its first page; a page after its end, or a timer once the stream's time has passed it, gives its row of counters (kind ``session``), empties its
    queue and forgets its keys.  Whichever comes first, the row is the same, so results do not depend on how pages fall into batches.

    Order holds over batches if pages arrive in order of time; those later than ``lateness`` are dropped by the watermark, which starts at 1970.  A learner's pages of one batch are sorted in
    one task, so the trigger bounds them.  State lies in RocksDB under the checkpoint and is restored from there.  A null learner is one of its own, null topics
    and null arrays offer nothing.
    """
    timed = pages.select("learner", "pos", "at", "topics").withWatermark("at", lateness)
    return timed.groupBy("learner").transformWithState(Learner(hours, cap, key_chars, min_chars), STEP, "append", "eventTime")


def started(spark: SparkSession, steps: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Steps of what has arrived, appended to parquet; the next call goes on from the checkpoint.

    ``partitions`` of the state are fixed by the first call of a checkpoint.  The session's own settings are as before when this returns.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return steps.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


carried(__name__)
