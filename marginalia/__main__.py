"""The verbs on a command line or for spark-submit: gauge, baseline, tells, detectors, segmenters.

    python -m marginalia gauge draft.md
    python -m marginalia gauge texts/ --format json --out reports
    python -m marginalia gauge draft.md --judgments draft.a.json --judgments draft.b.json --k 2
    python -m marginalia baseline references/ --k 2 --format markdown
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import readers
from .operators.detectors import detectors
from .operators.rules import catalogue
from .operators.segments import segmenters
from .plans import pages
from .plans import baseline as pooling
from .plans import gauge as plan
from .plans import report
from .sources import readers as sources

FORMATS = {"markdown": report.to_markdown, "json": report.to_json, "html": report.to_html}


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser("marginalia", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = top.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("gauge", help="how texts read, and why")
    one.add_argument("source", help="text files (a file, folder or pattern), - for standard input, or a text itself")
    one.add_argument("--format", choices=sorted(FORMATS), default="markdown")
    one.add_argument("--segmenter", default="paragraph")
    one.add_argument("--detectors", help="names by comma")
    one.add_argument("--judgments", action="append", default=[], help="a reader's file; give it once for each reader of the one text")
    one.add_argument("--k", type=int, default=2)
    one.add_argument("--baseline", help="what the verb baseline wrote as JSON")
    one.add_argument("--title")
    one.add_argument("--out", help="a file for one text, a folder of Parquet for more")
    two = verbs.add_parser("baseline", help="what readers find in reference texts, pooled")
    two.add_argument("source", help="a folder of texts with their readers' files")
    two.add_argument("--glob", default="*.md")
    two.add_argument("--judgments", help="where the readers' files are, if not beside the texts")
    two.add_argument("--k", type=int, default=2)
    two.add_argument("--format", choices=("json", "markdown"), default="json")
    two.add_argument("--out")
    three = verbs.add_parser("tells", help="the catalogue of phrases")
    three.add_argument("--tier")
    verbs.add_parser("detectors")
    verbs.add_parser("segmenters")
    return top.parse_args(given)


def _read(spark: SparkSession, source: str) -> DataFrame:
    if source == "-":
        return sources.literal_texts(spark, [sys.stdin.read()])
    if "://" in source or Path(source).exists() or any(c in source for c in "*?") and not any(c.isspace() for c in source):
        return sources.texts(spark, source)
    return sources.literal_texts(spark, [source])


def _gauge(spark: SparkSession, a: argparse.Namespace) -> str:
    readers.check_k(a.k, a.k)
    if a.baseline and len(a.judgments) < 2:
        raise ValueError("a baseline is set beside an agreement of readers: give judgments at least twice")
    docs = sources.dealt(_read(spark, a.source))
    chosen = [d.strip() for d in a.detectors.split(",") if d.strip()] if a.detectors else None
    extra, section = None, None
    if a.judgments:
        only = docs.select("doc_id").limit(2).collect()
        if len(only) != 1:
            raise ValueError("judgments are read for one text at a time")
        own = sources.judgment_rows(spark, [json.loads(Path(p).read_text(encoding="utf-8")) for p in a.judgments] if len(a.judgments) > 1 else Path(a.judgments[0]).read_text(encoding="utf-8"), only[0][0])
        if len(a.judgments) == 1:
            extra = readers.judgment_signals(docs, own)
        else:
            reading = readers.consensus(docs, own, a.k)
            extra = readers.consensus_signals(readers.consensus_units(docs, own, a.k), reading)
            beside = readers.compared(reading, sources.baseline_from(spark, a.baseline)) if a.baseline else reading
            section = report.readers_section(beside, readers.reader_counts(docs, own), bool(a.baseline))
    made = plan.reports(docs, a.segmenter, chosen, extra=extra)
    titled = {} if a.title is None or a.format == "json" else {"title": a.title}
    if section is not None and a.format == "markdown":
        titled["readers"] = "readers"
        made = made.join(section, "doc_id", "left")
    elif section is not None and a.format == "json":
        made = made.join(beside.select("doc_id", F.struct(*(c for c in beside.columns if c != "doc_id")).alias("readers")), "doc_id", "left")
    shown = FORMATS[a.format](made, keep=("label", "lean", "n_signals"), **titled).withColumnRenamed(a.format, "page")
    if not a.out or _single(docs):
        some = shown.limit(2).collect()
        if len(some) != 1:
            raise ValueError("several texts need --out, a folder for a page of each" if some else "no text was found")
        (row,) = some
        if not a.out:
            return row["page"]
        Path(a.out).write_text(row["page"], encoding="utf-8")
        return f"wrote {a.out} ({len(row['page'].encode())} bytes): {row['label']}, lean {row['lean']:+.2f}, {row['n_signals']} signal(s)"
    told = pages.save_pages(shown, a.out, {"markdown": "md"}.get(a.format, a.format))
    return f"wrote {told['pages']} pages to {a.out} ({told['bytes']} bytes): " + ", ".join(f"{k} {v}" for k, v in told["labels"].items())


def _single(docs: DataFrame) -> bool:
    """Whether there is one text at most; ids alone are read."""
    return len(docs.select("doc_id").limit(2).collect()) < 2


def _baseline(spark: SparkSession, a: argparse.Namespace) -> str:
    docs, judgments = pooling.reference_files(spark, a.source, a.glob, a.judgments)
    pooled, readings = pooling.baseline(docs, judgments, a.k)
    if a.format == "json":
        shown = pooled.select(F.to_json(F.struct("*"))).first()[0]
    else:
        lines = "\n".join(r["line"] for r in report.baseline_rows(readings).orderBy("doc_id").toLocalIterator())
        shown = report.baseline_told(pooled).first()[0] + pooling.TABLE + lines + "\n" + pooling.CLOSING
    if not a.out:
        return shown
    Path(a.out).write_text(shown, encoding="utf-8")
    row = pooled.first()
    return f"wrote {a.out}: {row['n_texts']} text(s), {row['machine_per_1000']} per 1,000 words machine-leaning"


def run(spark: SparkSession, given: Sequence[str] | None = None) -> str:
    """What a command line prints."""
    a = arguments(given)
    if a.verb == "gauge":
        return _gauge(spark, a)
    if a.verb == "baseline":
        return _baseline(spark, a)
    rows = {"tells": lambda: catalogue(spark, a.tier), "detectors": lambda: detectors(spark), "segmenters": lambda: segmenters(spark)}[a.verb]()
    return "\n".join(json.dumps(r.asDict(), ensure_ascii=False) for r in rows.collect())


if __name__ == "__main__":
    try:
        print(run(SparkSession.builder.appName("marginalia").getOrCreate()))
    except (ValueError, KeyError) as e:
        sys.exit(f"marginalia: {e.args[0]}")
