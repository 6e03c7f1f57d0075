"""Documents, judgments, rules and baselines from files, by Spark's own readers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.detectors import Detector
from ..operators.detectors import rhythm as built_in_rhythm
from ..operators.detectors import tells as built_in_tells
from ..operators.rules import METRICS, Rule
from ..schema import JUDGMENT

# What an upload may be called, and how large it may be.
UPLOAD_EXTENSIONS = ("txt", "md", "markdown", "text")
UPLOAD_BYTES = 2_000_000
#: Records of one reader, bare or in an envelope.
_FILE = f"judgments array<{JUDGMENT}>, findings array<{JUDGMENT}>, list array<{JUDGMENT}>"
_REFUSED = "not a reader's judgments: expected records with a direction, in a list, or under judgments or findings"


def dealt(rows: DataFrame) -> DataFrame:
    """``rows``, dealt out anew if they come in fewer splits than there are cores.

    Detecting costs far more than moving a text once, and a table in one row
    group would be one task. A table that fills the cluster stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables, in as many splits as there are cores at least."""
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def texts(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(doc_id, text) of text files, one document each, named by its path."""
    reader = spark.read.option("wholetext", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.text(paths).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def literal_texts(spark: SparkSession, rows: Sequence[str]) -> DataFrame:
    """(doc_id, text) of texts given as such, numbered from 0."""
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def uploads(spark: SparkSession, path: str, extensions: Sequence[str] = UPLOAD_EXTENSIONS, most: int = UPLOAD_BYTES) -> DataFrame:
    """(doc_id, text, refused): files as texts with \\n line ends; those of other names, too long, or not UTF-8 with the reason."""
    files = spark.read.format("binaryFile").load(path)
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    refused = F.when(~ending.isin(*extensions), "name").when(F.col("length") > most, "size").when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding")
    text = F.regexp_replace(F.col("content").cast("string"), r"\r\n?", "\n")
    return files.select(F.col("path").alias("doc_id"), F.when(refused.isNull(), text).alias("text"), refused.alias("refused"))


def parsed_judgments(records: DataFrame, keep: Sequence[str] = ("doc_id", "reader"), column: str = "json") -> DataFrame:
    """Rows of judgments from JSON texts: a list of records, or an object with it under judgments or findings.

    Anything else stops the job, since an empty reader would change who agrees
    with whom. A reader who flags nothing is one row without a direction, so
    that it counts among the readers. Values may be of any kind and stay JSON.
    """
    wrapped = F.when(F.btrim(column).startswith("["), F.concat(F.lit('{"list":'), F.col(column), F.lit("}"))).otherwise(F.col(column))
    x = F.from_json(wrapped, _FILE, {"mode": "PERMISSIVE"})
    own = F.coalesce(x["list"], x["judgments"], x["findings"])
    fine = F.when(own.isNotNull() & ~F.exists(own, lambda j: j["direction"].isNull()), own).otherwise(F.raise_error(F.concat(*(y for k in keep for y in (F.col(k).cast("string"), F.lit(": "))), F.lit(_REFUSED))))
    return records.select(*keep, F.explode_outer(fine).alias("j")).select(*keep, "j.*")


def judgment_files(spark: SparkSession, path: str | Sequence[str], documents: DataFrame | None = None) -> DataFrame:
    """Judgments of ``<document>.<reader>.json`` beside a document, or ``<document>/<reader>.json`` in a folder named after it.

    (folder, document, reader, reader_at, ...): all names come from the paths,
    ``folder`` being where the document would lie, so that documents of one
    name in two folders stay two. ``reader_at`` is the reader's place among its
    document's files by name. A file found twice is read once; with
    ``documents`` (document), files of others are not looked into.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("json")).distinct()
    stem = F.regexp_extract("p", r"([^/]+)\.json$", 1)
    dotted = stem.rlike(r"^[^.].*\.[^.]+$")
    document = F.when(dotted, F.regexp_replace(stem, r"\.[^.]+$", "")).otherwise(F.regexp_extract("p", r"([^/]+)/[^/]+\.json$", 1))
    folder = F.when(dotted, F.regexp_extract("p", r"^(.*)/[^/]+$", 1)).otherwise(F.regexp_extract("p", r"^(.*)/[^/]+/[^/]+$", 1))
    reader = F.when(dotted, F.element_at(F.split(stem, r"\."), -1)).otherwise(stem)
    named = files.select(folder.alias("folder"), document.alias("document"), reader.alias("reader"), "p", "json")
    named = named if documents is None else named.join(documents.select("document").distinct(), "document", "left_semi")
    own = Window.partitionBy("folder", "document").orderBy("p")
    return parsed_judgments(named.withColumn("reader_at", F.row_number().over(own)), ("folder", "document", "reader", "reader_at"))


def readers_of(judgments: object) -> list[tuple[str, list[dict]]]:
    """Readers and their records from what a caller holds: none, one reader's list or envelope, or a list of those.

    A list that mixes records with readers has no reading but a guess, and is refused.
    """
    is_record = lambda x: isinstance(x, dict) and "direction" in x
    value = json.loads(judgments) if isinstance(judgments, str) else judgments

    def one(name: str, x: object) -> tuple[str, list[dict]]:
        x = json.loads(x) if isinstance(x, str) else x
        if isinstance(x, dict):
            x = x.get("judgments", x.get("findings"))
        if not isinstance(x, list) or not all(map(is_record, x)):
            raise ValueError(f"{name}: {_REFUSED}")
        return name, x

    if value is None or value == [] and not isinstance(judgments, str):
        return []
    if isinstance(value, dict) or isinstance(value, list) and all(map(is_record, value)):
        return [one("reader 1", value)]
    if isinstance(value, list) and not any(map(is_record, value)):
        return [one(f"reader {i + 1}", x) for i, x in enumerate(value)]
    raise ValueError("judgments mixes single records with whole readers; give one reader's records, or an entry for each reader")


def judgment_rows(spark: SparkSession, judgments: object, doc_id: object) -> DataFrame:
    """The readers of ``readers_of`` on one document as rows of judgments."""
    rows = [(doc_id, name, k + 1, json.dumps(records)) for k, (name, records) in enumerate(readers_of(judgments))]
    kind = "long" if isinstance(doc_id, int) else "string"
    return parsed_judgments(spark.createDataFrame(rows, f"doc_id {kind}, reader string, reader_at int, json string"), ("doc_id", "reader", "reader_at"))


def _catalogue(path: str):
    """What a catalogue's file says, JSON or YAML."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("a YAML catalogue needs the yaml package; give JSON instead") from e
    return yaml.safe_load(text)


def rules_from(path_or_rules: str | Sequence[dict]) -> tuple[Rule, ...]:
    """Rules from records with id, tier, message, patterns and perhaps a weight, or from a JSON or YAML file of them."""
    records = _catalogue(path_or_rules) if isinstance(path_or_rules, str) else path_or_rules
    records = records["rules"] if isinstance(records, dict) else records
    return tuple(Rule(r["id"], r["tier"], r["message"], tuple(r["patterns"]), None if r.get("weight") is None else float(r["weight"])) for r in records)


def metrics_from(path: str | None = None) -> dict[str, float]:
    """The numbers that detectors share: those of a catalogue's file, JSON or YAML, where it has them, else the built-in ones."""
    found = _catalogue(path) if path is not None else None
    return {**METRICS, **((found.get("metrics") or {}) if isinstance(found, dict) else {})}


def detectors_from(path: str) -> list[str | Detector]:
    """The default detectors with a catalogue's own rules and numbers, for ``detectors=``."""
    rules, numbers = rules_from(path), metrics_from(path)

    def tells(text: Column, start: Column) -> Column:
        return built_in_tells(text, start, rules)

    def rhythm(text: Column, start: Column) -> Column:
        return built_in_rhythm(text, start, numbers)

    return [tells, "forensic", "rhetoric", rhythm]


def baseline_from(spark: SparkSession, path: str) -> DataFrame:
    """A baseline as ``operators.readers.pooled`` makes it, from JSON lines of it, or of readings that are pooled here."""
    from ..operators.readers import pooled

    rows = spark.read.json(path)
    if "n_texts" in rows.columns:
        return rows
    if "n_units" in rows.columns:
        return pooled(rows)
    raise ValueError("neither a baseline nor readings: give the JSON of one or the other")


def annotated(spark: SparkSession, path: str, intervals: str = "ai_char_intervals") -> tuple[DataFrame, DataFrame]:
    """Documents with known origin, ``{"documents": [{id, text, intervals}]}``: (doc_id, text) and truth (doc_id, start, end)."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("documents").alias("d"))
    docs = rows.select(F.col("d.id").alias("doc_id"), F.col("d.text").alias("text"))
    truth = rows.select(F.col("d.id").alias("doc_id"), F.explode(f"d.{intervals}").alias("x")).select("doc_id", F.col("x")[0].cast("int").alias("start"), F.col("x")[1].cast("int").alias("end"))
    return docs, truth


def bands(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(band, text) of JSON lines with a text, a path for each band."""
    out = None
    for band, path in paths.items():
        part = spark.read.schema("text string").json(path).select(F.lit(band).alias("band"), "text")
        out = part if out is None else out.unionByName(part)
    return out
