"""Verdicts of a stream of documents and one of judgments, which come in any order."""

from __future__ import annotations

import datetime
import random

from marginalia.operators import readers
from marginalia.plans import gauge as plan
from marginalia.schema import JUDGMENT
from marginalia.seeds import seeded
from marginalia.streaming import judged

DOCS, JUDGMENTS = "doc_id long, text string, at timestamp", "doc_id long, reader string, at timestamp, " + JUDGMENT.removeprefix("struct<").removesuffix(">").replace(":", " ")


def test_any_order_ends_as_the_batch_does(spark, tmp_path):
    rng = random.Random(7)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randint(0, 50))
    texts = [tuple(r) for r in seeded(spark, "/root/testdata/sf0.001").select("doc_id", "text").where("doc_id < 30").collect()] + [(100, ""), (101, None)]
    said = []
    for d, text in texts:
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, max(0, len(text or "") - 30))
            quote, start, end = rng.choice([((text or "x")[a : a + 12], None, None), ("is nowhere at all", None, None), (None, a, a + rng.choice([3, 25, 4000])), (None, None, None)])
            said.append((d, "a", at(), rng.choice(["machine", "human", "neutral", None]), quote, start, end, None, rng.choice([None, 0.2, 0.9]), None, None, None))
    docs = [(d, t, at()) for d, t in texts]
    rng.shuffle(docs)
    for k in range(3):
        # judgments of documents that are there, that come with them, and that are still to come
        spark.createDataFrame(docs[k::3], DOCS).write.parquet(f"{tmp_path}/docs/{k}")
        spark.createDataFrame(said[k::3], JUDGMENTS).write.parquet(f"{tmp_path}/said/{k}")
        stream = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
        out = judged.judged_verdicts(stream("docs", DOCS), stream("said", JUDGMENTS), "sentence", delay="2 hours")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    columns = ["doc_id", "n_segments", "n_signals", "lean", "strength", "label"]
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() > len(texts)
    got = sorted(map(tuple, judged.newest(rows).select(*columns).collect()))
    frame, own = spark.createDataFrame(docs, DOCS), spark.createDataFrame(said, JUDGMENTS)
    batch = plan.verdicts(frame, "sentence", extra=readers.judgment_signals(frame, own)).where("doc_id <> 101").select(*columns)
    assert got == sorted(map(tuple, batch.collect()))
