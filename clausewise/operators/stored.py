"""Tables that are written to: merges that rewrite the buckets they touch, and hash chains that are appended to.

A folder has data under version numbers and a small commit file for each version, which names what of the data counts and the
batches it holds.  A version's commit file is created once and by one writer; whoever comes second fails and has
changed nothing, and data that no commit names is never read.  A batch that is in a commit already is a replay and does nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.work import written

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


class Versioned:
    """Commit files of a folder: numbers from 1, each with a note (JSON)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: object) -> object:
        return self._hadoop.Path("/".join([self.folder, *map(str, parts)]))

    def newest(self) -> tuple[int, dict]:
        """Number and note of the last version; 0 and nothing before the first."""
        top = self._path("commits")
        if not self._fs.exists(top):
            return 0, {}
        for number in sorted((int(s.getPath().getName()) for s in self._fs.listStatus(top) if s.getPath().getName().isdigit()), reverse=True):
            stream = self._fs.open(self._path("commits", number))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            # a commit that is being written is none yet
            if text.endswith("\n"):
                return number, json.loads(text)
        return 0, {}

    def fresh(self, number: int) -> str:
        """A name for the data of one attempt at a version: two writers of one number never share it."""
        return f"{number}-{uuid.uuid4().hex[:12]}"

    def commit(self, number: int, note: dict) -> None:
        try:
            out = self._fs.create(self._path("commits", number), False)
        except Exception as e:
            raise Conflict(f"version {number} of {self.folder} is another writer's") from e
        out.write(bytearray(json.dumps(note).encode() + b"\n"))
        out.close()


class Table(Versioned):
    """Rows of one schema, by buckets of a key (null-safe)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str]):
        super().__init__(spark, folder)
        self.schema, self.key = schema, key

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(BUCKETS)).cast("int").alias("bucket")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """What counts now, of all buckets or of some: files of other versions and buckets are not opened."""
        held = {int(b): v for b, v in self.newest()[1].get("buckets", {}).items() if buckets is None or int(b) in buckets}
        columns = self.spark.createDataFrame([], self.schema).columns
        if not held:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(f"{self.schema}, bucket int, version string").parquet(f"{self.folder}/data")
        of = {v: [b for b, w in held.items() if w == v] for v in set(held.values())}
        wanted = F.lit(False)
        for version, own in sorted(of.items()):
            wanted |= (F.col("version") == version) & F.col("bucket").isin(own)
        return found.where(wanted).select(*columns)

    def merge(self, batch: str, incoming: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Take in a batch: the buckets of its keys become ``rule(what they hold, incoming)``; False if it was taken in before."""
        number, note = self.newest()
        if batch in note.get("batches", []):
            return False
        fresh = written(incoming.withColumn("__bucket", self._bucket()), "merge-batch")
        touched = sorted(r[0] for r in fresh.select("__bucket").distinct().collect())
        version = self.fresh(number + 1)
        if touched:
            out = rule(self.rows(touched), fresh.drop("__bucket")).select(*self.spark.createDataFrame([], self.schema).columns, self._bucket())
            out.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/version={version}")
        self.commit(number + 1, {"batches": [*note.get("batches", []), batch], "buckets": {**note.get("buckets", {}), **{str(b): version for b in touched}}})
        return True


ENTRY = "chain long, seq long, body string, prev_hash string, entry_hash string"


def folded(entries: DataFrame, genesis: str) -> DataFrame:
    """``ENTRY`` rows of new entries (chain, place, body, and the chain's tail: last_seq, last_hash), in the order of their place.

    A hash needs the one before it, so a chain is walked once, in a stream of its sorted rows; what is carried along is one hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, seq, last, begun = None, -1, genesis, False
        for batch in batches:
            chains, bodies, seqs, lasts = (batch.column(k).to_pylist() for k in range(4))
            out_seq, before, hashes = [], [], []
            for c, body, tail_seq, tail in zip(chains, bodies, seqs, lasts, strict=True):
                if not begun or c != chain:
                    chain, begun = c, True
                    seq, last = (-1, genesis) if tail is None else (tail_seq, tail)
                seq += 1
                before.append(last)
                last = hashlib.sha256(((body or "") + last).encode()).hexdigest()
                out_seq.append(seq)
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out_seq, pa.int64()), batch.column(1), pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=["chain", "seq", "body", "prev_hash", "entry_hash"])

    return entries.repartition("chain").sortWithinPartitions("chain", "place").select("chain", "body", "last_seq", "last_hash").mapInArrow(run, ENTRY)


class Chains(Versioned):
    """Hash chains in a folder: an append reads the tails of its chains and folds its own entries only."""

    def __init__(self, spark: SparkSession, folder: str, genesis: str):
        super().__init__(spark, folder)
        self.genesis = genesis

    def _held(self, what: str, schema: str) -> DataFrame:
        number, note = self.newest()
        if not number:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, version string").parquet(f"{self.folder}/{what}").where(F.col("version").isin(note["versions"])).drop("version")

    def entries(self) -> DataFrame:
        return self._held("entries", ENTRY)

    def tails(self) -> DataFrame:
        """chain, last_seq, last_hash: each version writes the tails of the chains it lengthened, and the longest counts."""
        every = self._held("tails", "chain long, last_seq long, last_hash string")
        return every.groupBy("chain").agg(F.max("last_seq").alias("last_seq"), F.max_by("last_hash", "last_seq").alias("last_hash"))

    def append(self, batch: str, entries: DataFrame) -> bool:
        """Lengthen chains by entries (chain, place, body); False if the batch was appended before, ``Conflict`` if another was meanwhile."""
        number, note = self.newest()
        if batch in note.get("batches", []):
            return False
        new = folded(entries.select("chain", "place", "body").join(self.tails(), "chain", "left"), self.genesis)
        version = self.fresh(number + 1)
        new.write.parquet(f"{self.folder}/entries/version={version}")
        done = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/entries/version={version}")
        done.groupBy("chain").agg(F.max("seq").alias("last_seq"), F.max_by("entry_hash", "seq").alias("last_hash")).write.parquet(f"{self.folder}/tails/version={version}")
        self.commit(number + 1, {"batches": [*note.get("batches", []), batch], "versions": [*note.get("versions", []), version]})
        return True
