"""Files in and out: tables, corpora, dictionaries, rates, weights, event datasets with their settings."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators.order import numbered


def tabular(spark: SparkSession, path: str, lower: bool = True, max_cues: int = 30_000, max_outcomes: int = 60_000) -> DataFrame:
    """Events of a tab-separated file with a header and exactly three columns: cues, outcomes, frequency."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_line"))
    rows = lines.where("_line > 0 or value not like '%\t%\t%'").where("_line > 0 and value <> ''")
    parts = F.split("value", "\t", -1)
    three = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three columns: "), F.col("value"))).cast("array<string>"))
    frame = rows.select("_line", three.alias("p")).select("_line", F.col("p")[0].alias("Cues"), F.col("p")[1].alias("Outcomes"), F.col("p")[2].cast("long").alias("Frequency"))
    found = E.from_frame(frame, ["_line"], lower, sort=True)
    return E.threshold(found, max_cues, max_outcomes)


def extended_corpus(spark: SparkSession, path: str, **more) -> DataFrame:
    """Events of a corpus with one token a line (form TAB outcomes...)."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    return E.from_extended(lines, "line", **more)


def corpus(spark: SparkSession, path: str, **more) -> DataFrame:
    """Events of running text, each file a document."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return E.from_corpus(docs, **more)


def alphabet(spark: SparkSession, path: str) -> str:
    """The letters of a file with one a line, "#" first; a longer line is an error, repeated letters count once."""
    letters = [r[0] for r in spark.read.text(path).select(F.trim("value")).where("trim(value) <> ''").distinct().collect()]
    if bad := [x for x in letters if len(x) > 1]:
        raise ValueError(f"more than one letter in a line: {bad[0]!r}")
    return "#" + "".join(sorted(set(letters) - {"#"}))


def dictionary(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(name, id); a name that is there twice is an error."""
    d = spark.read.csv(path, sep=separator, schema="name string, id long", quote="")
    return _once(d, "name")


def rates(spark: SparkSession, path: str, of: str = "cue") -> DataFrame:
    """(cue or outcome, value) of a file of names and rates; rates outside (0, 1] are left out."""
    d = spark.read.csv(path, sep=" ", schema=f"{of} string, value double", quote="")
    return _once(d, of).where("value > 0 and value <= 1")


def _once(d: DataFrame, key: str) -> DataFrame:
    twice = d.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]!r} is there more than once")
    return d


def write_dictionary(d: DataFrame, path: str) -> None:
    d.select("name", "id").write.csv(path, sep="\t", quote="")


# ---------------------------------------------------------------- weights
def write_weights(weights: DataFrame, path: str, info: dict | None = None, overwrite: bool = False) -> None:
    """Weights as Parquet, sorted by cue so that a selection reads few row groups, and what they come from as JSON."""
    weights.repartitionByRange("cue").sortWithinPartitions("cue", "outcome").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    _put(weights.sparkSession, path + ".info.json", json.dumps(info or {}, sort_keys=True))


def read_weights(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(path), json.loads(_get(spark, path + ".info.json") or "{}")


def write_weights_text(weights: DataFrame, path: str, digits: int = 12) -> None:
    """A dense tab-separated matrix, cues by outcomes, with the digits asked for."""
    outcomes = sorted(r[0] for r in weights.select("outcome").distinct().collect())
    wide = weights.groupBy("cue").pivot("outcome", outcomes).agg(F.first("weight"))
    cell = F.udf(lambda x: f"{x or 0.0:.{digits}g}", "string")
    wide.orderBy("cue").select("cue", *(cell(f"`{o}`").alias(o) for o in outcomes)).write.csv(path, sep="\t", header=True, quote="")


def read_weights_binary(spark: SparkSession, path: str) -> DataFrame:
    """(cue, outcome, weight) of a row-major file of doubles with its names beside it (path.cues, path.outcomes)."""
    names = [sorted(((int(r["id"]), r["name"]) for r in dictionary(spark, f"{path}.{x}").collect())) for x in ("cues", "outcomes")]
    cues, outcomes = ([n for _, n in x] for x in names)
    w = np.fromfile(path, np.float64).reshape(len(cues), len(outcomes))
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"cue": pa.array(np.repeat(cues, len(outcomes))), "outcome": pa.array(np.tile(outcomes, len(cues))), "weight": pa.array(w.reshape(-1))}))


# ---------------------------------------------------------------- event files of the older binary layout
MAGIC, VERSION = 14159265, 215


def read_binary_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, cues, outcomes, freq), names as numbers, of files of 8-byte words: magic, version, count, then each event."""
    import pyarrow as pa

    def parse(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = struct.unpack(f"<{len(data) // 8}Q", data)
                if len(w) < 3 or w[0] != MAGIC or w[1] != VERSION:
                    raise ValueError(f"{name}: not an event file of version {VERSION}")
                at, out = 3, []
                for i in range(w[2]):
                    n = w[at]
                    cues = w[at + 1 : at + 1 + n]
                    at += 1 + n
                    m = w[at]
                    outs = w[at + 1 : at + 1 + m]
                    at += 2 + m
                    out.append((name, i, list(cues), list(outs), w[at - 1]))
                cols = list(zip(*out)) if out else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "i", "cues", "outcomes", "freq"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, i long, cues array<long>, outcomes array<long>, freq long")


# ---------------------------------------------------------------- event datasets
def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(p) else None


@dataclass(frozen=True)
class EventDataset:
    """Events as Parquet, range-partitioned by event_id, with settings beside them that say what they were made of."""

    spark: SparkSession = field(compare=False)
    path: str = field(compare=False)
    settings: dict

    @classmethod
    def write(cls, events: DataFrame, path: str, overwrite: bool = False, **settings) -> EventDataset:
        spark = events.sparkSession
        events.repartitionByRange("event_id").sortWithinPartitions("event_id").write.mode("overwrite" if overwrite else "errorifexists").parquet(path + "/events")
        kept = spark.read.parquet(path + "/events")
        made = settings | {"events": kept.count()} | {of: kept.select(F.explode(of)).distinct().count() for of in ("cues", "outcomes")}
        _put(spark, path + "/settings.json", json.dumps(made, sort_keys=True))
        return cls(spark, path, made)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> EventDataset:
        found = _get(spark, path + "/settings.json")
        if found is None:
            raise FileNotFoundError(path)
        return cls(spark, path, json.loads(found))

    @property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(self.path + "/events")

    def count(self) -> int:
        return self.settings["events"]

    def view(self, start: int = 0, count: int = 10, **more) -> DataFrame:
        return E.view(self.events, start, count, **more)

    def differences(self, other: EventDataset) -> dict:
        """Settings that differ: (mine, the other's)."""
        keys = sorted(set(self.settings) | set(other.settings))
        return {k: (self.settings.get(k), other.settings.get(k)) for k in keys if self.settings.get(k) != other.settings.get(k)}

    def delete(self) -> None:
        """Removes the files, if the settings there are still these."""
        if EventDataset.open(self.spark, self.path).settings != self.settings:
            raise ValueError("the dataset has changed since it was opened")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def from_frame(df: DataFrame, path: str, lower: bool = True, max_cues: int = 30_000, max_outcomes: int = 60_000, order=()) -> EventDataset:
    """A frame's events with thresholds, as a dataset."""
    found = E.from_frame(df if "event_id" in df.columns else numbered(df, list(order) or df.columns), lower=lower, sort=True)
    return EventDataset.write(E.threshold(found, max_cues, max_outcomes), path, kind="frame", lower=lower, max_cues=max_cues, max_outcomes=max_outcomes)
