"""Readings of documents as they arrive, and findings as documents are edited."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detectors import Detector
from ..operators.scoring import Aggregate
from ..operators.segments import Segmenter
from ..plans.gauge import gauge
from ..shipping import ship


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_at_once: int = 64) -> DataFrame:
    """A stream of the documents in a folder's Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def segment_stream(docs: DataFrame, segmenter: str | Segmenter = "paragraph", detectors: Sequence[str | Detector] | None = None, aggregate: str | Aggregate = "density_aggregate") -> DataFrame:
    """Scored segments as documents arrive: the plan of a batch, without state, for append mode."""
    return gauge(docs, segmenter, detectors, aggregate)


#: Findings to follow (kind ``finding``) and edits (kind ``edit``), which put ``inserted`` code points for [start, end).
EVENTS = "doc_id long, kind string, seq long, seg_idx int, start int, end int, inserted int"
FOLLOWED = "doc_id long, seq long, seg_idx int, start int, end int, unverified boolean"


def _moved(pos: int, a: int, b: int, inserted: int, behind: bool) -> int:
    if pos < a:
        return pos
    if pos > b:
        return pos + inserted - (b - a)
    side = behind if a == b else False if pos == a else True if pos == b else behind
    return a + (inserted if side else 0)


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    rows = list(zip(*state.get)) if state.exists else []
    findings = {int(i): [int(a), int(b), bool(u)] for i, a, b, u in rows}
    events = sorted((tuple(r) for f in frames for r in f[["seq", "kind", "seg_idx", "start", "end", "inserted"]].itertuples(index=False)), key=lambda r: (r[0], r[1] != "finding"))
    out = []
    for seq, kind, seg, start, end, inserted in events:
        if kind == "finding":
            findings[int(seg)] = [int(start), int(end), False]
            continue
        for i, f in sorted(findings.items()):
            f[0], f[1] = _moved(f[0], start, end, inserted, True), _moved(f[1], start, end, inserted, False)
            f[2] = f[2] or (start <= f[1] and start + inserted >= f[0])
            out.append((key[0], int(seq), i, f[0], f[1], f[2]))
    state.update(([*findings], [f[0] for f in findings.values()], [f[1] for f in findings.values()], [f[2] for f in findings.values()]))
    yield pd.DataFrame(out, columns=["doc_id", "seq", "seg_idx", "start", "end", "unverified"])


def edit_stream(events: DataFrame) -> DataFrame:
    """A row for each finding after each edit of its document: where it is now, and whether an edit touched it.

    A document's findings are its state; edits come in the order of ``seq``
    within a trigger. What comes late counts after what was there before.
    """
    ship(events.sparkSession)
    state = "idx array<int>, start array<int>, end array<int>, unverified array<boolean>"
    return events.groupBy("doc_id").applyInPandasWithState(_follow, FOLLOWED, state, "append", GroupStateTimeout.NoTimeout)
