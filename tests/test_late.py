"""Late results as keyed state: stale tickets, restarts, texts that come back, any order and triggers."""

from __future__ import annotations

import datetime
import random

import pytest

from marginalia.operators import edits
from marginalia.streaming import late


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


class Run:
    """A stream over files that are put there one by one; each trigger is a query started anew from the checkpoint."""

    def __init__(self, spark, top, **options):
        self.spark, self.top, self.options, self.n = spark, top, options, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, late.EVENTS).coalesce(1).write.parquet(f"{self.top}/in/{self.n:03d}")
        self.n += 1
        events = self.spark.readStream.schema(late.EVENTS).option("recursiveFileLookup", "true").parquet(f"{self.top}/in")
        run = late.latest(events, **self.options).writeStream.format("parquet").option("path", f"{self.top}/out").option("checkpointLocation", f"{self.top}/cp").trigger(availableNow=True).start()
        run.awaitTermination(120)
        return sorted(map(tuple, self.spark.read.parquet(f"{self.top}/out").collect()))


def test_stale_tickets_go_in_any_window_and_after_a_restart(spark, tmp_path):
    run = Run(spark, tmp_path)
    first = (1, 1, "A", 1, "r1")
    assert run.put([(1, "text", 1, "A", at(0), None), (1, "result", 1, "A", at(9), "r1")]) == [first]
    second = [first, (1, 1, "A", 2, "r2")]
    assert run.put([(1, "result", 2, "A", at(11), "r2")]) == second
    # replays, and the first ticket once more behind the second, in later windows
    assert run.put([(1, "result", 1, "A", at(9), "r1"), (1, "result", 2, "A", at(11), "r2")]) == second
    assert run.put([(1, "result", 1, "A", at(31), "r1 again")]) == second
    # the text changes: results of the old one are of no use, whatever their ticket
    third = [*second, (1, 2, "B", 4, "r4")]
    assert run.put([(1, "text", 2, "B", at(32), None), (1, "result", 3, "A", at(33), "r3"), (1, "result", 4, "B", at(34), "r4")]) == third
    # and when it comes back, so does its last result
    assert run.put([(1, "text", 3, "A", at(40), None)]) == [*third, (1, 3, "A", 3, "r3")]


def test_results_may_come_before_their_text(spark, tmp_path):
    run = Run(spark, tmp_path)
    assert run.put([(1, "result", 5, "A", at(0), "early"), (2, "text", 1, None, at(0), None), (None, "text", 1, "A", at(0), None), (3, "result", None, "A", at(0), None)]) == []
    assert run.put([(1, "text", 1, "A", at(1), None), (2, "result", 1, None, at(1), "of no text")]) == [(1, 1, "A", 5, "early"), (2, 1, "", 1, "of no text")]


def test_state_is_forgotten_and_nothing_stale_revives(spark, tmp_path):
    run = Run(spark, tmp_path, remember="30 minutes", delay="1 minute")
    own = [(1, "text", 1, "A", at(0), None), (1, "result", 2, "A", at(1), "r2")]
    shown = run.put(own)
    run.put([(9, "text", 1, "Z", at(100), None)])
    run.put([(9, "text", 2, "Z", at(101), None)])
    # the timer has fired, and what is replayed is late for the watermark
    assert run.put(own) == shown
    assert run.put([(1, "text", 1, "B", at(102), None), (1, "result", 1, "B", at(103), "new")]) == [*shown, (1, 1, "B", 1, "new")]


@pytest.mark.parametrize("seed", range(2))
def test_any_order_and_triggers_end_as_the_batch_does(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, texts = [], {}
    for doc in range(12):
        for k in range(1, 4):
            texts[doc] = rng.choice("ABC")
            rows.append((doc, "text", k, texts[doc], at(rng.randint(0, 30)), None))
        rows += [(doc, "result", k, rng.choice("ABC"), at(rng.randint(0, 30)), f"r{k}") for k in range(1, 7)]
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    run = Run(spark, tmp_path, delay="1 hour")
    for k in range(3):
        run.put(rows[k::3])
    got = sorted(map(tuple, late.shown(spark.read.parquet(f"{tmp_path}/out")).collect()))
    digest = {x: __import__("hashlib").sha256(x.encode()).hexdigest() for x in "ABC"}
    results = sorted({(r[0], digest[r[3]], r[2], r[5], r[3]) for r in rows if r[1] == "result"})
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    batch = edits.current(spark.createDataFrame(results, "doc_id long, text_sha256 string, ticket long, report string, name string"), docs)
    assert got == sorted((r["doc_id"], r["name"], r["ticket"], r["report"]) for r in batch.collect())


def test_a_plain_stream_of_events_has_no_doc_without_a_result(spark, tmp_path):
    assert Run(spark, tmp_path).put([(1, "text", 1, "A", at(0), None)]) == []
