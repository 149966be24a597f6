"""The fingerprints of earlier runs, kept as a table that later runs compare with.

Layout.  A *segment* holds what one batch brought, as Parquet in hash buckets of the fingerprint; a snapshot
lists the segments in force.  A batch first writes its segment and then a snapshot, each in one
Spark job, so what a lost driver leaves half written is never read.  A batch that is
repeated under its label compares with all others and replaces its own segment.

Reading.  A batch reads the buckets that its own fingerprints fall into, and of those only what a Bloom filter of the
batch lets through is shuffled to the anti join.  A batch too large for a filter of bounded size joins without.

``compact`` merges segments into one, apart from the latest, which a repeated batch may still replace.
``vacuum`` deletes files that no snapshot needs; no reader may be at work then.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from keysift.functions.bloom import bits_for, bloom_filter, may_hold
from keysift.plans.durable import discard, materialise

_SNAPSHOT = "version long, n_buckets int, segment string, label string, n long, place long, live boolean"
_SEGMENT = "fp binary, bucket int"


class FingerprintStore:
    """Fingerprints under ``path``, which the cluster shares; ``n_buckets`` is fixed when the store is made."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64):
        self._spark, self._path = spark, path.rstrip("/")
        self._rows, self._version = self._snapshot()
        self.n_buckets = self._rows[0]["n_buckets"] if self._rows else n_buckets
        if not self._rows:
            self._write([])

    # ── Snapshots ──

    def _snapshot(self) -> tuple[list[Row], int]:
        """All rows of the newest snapshot: a line for the store and one per segment."""
        try:
            rows = self._spark.read.schema(_SNAPSHOT).parquet(f"{self._path}/snapshots/*").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return [], 0
        newest = max((r["version"] for r in rows), default=0)
        return [r for r in rows if r["version"] == newest], newest

    def _write(self, segments: list[dict]) -> None:
        old, self._version = self._version, self._version + 1
        head = {"version": self._version, "n_buckets": self.n_buckets, "segment": None, "label": None, "n": 0, "place": -1, "live": True}
        rows = [head, *(s | {"version": self._version, "n_buckets": self.n_buckets} for s in segments)]
        names = [c.split()[0] for c in _SNAPSHOT.split(", ")]
        frame = self._spark.createDataFrame([tuple(r[c] for c in names) for r in rows], _SNAPSHOT)
        frame.coalesce(1).write.parquet(f"{self._path}/snapshots/{self._version}")
        self._rows = frame.collect()
        if old:
            discard(self._spark, f"{self._path}/snapshots/{old}")

    def _segments(self, live: bool = True) -> list[dict]:
        found = [r.asDict() for r in self._rows if r["segment"] is not None]
        return sorted((s for s in found if s["live"] or not live), key=lambda s: s["place"])

    # ── Reading ──

    def _bucket(self, fp: Column) -> Column:
        return F.pmod(F.xxhash64(fp), F.lit(self.n_buckets)).cast("int")

    def _read(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self._spark.createDataFrame([], _SEGMENT)
        base = f"{self._path}/segments"
        return (self._spark.read.schema(f"{_SEGMENT}, segment string").option("basePath", base)
                .parquet(*(f"{base}/segment={s['segment']}" for s in segments)))

    def fingerprints(self) -> DataFrame:
        """(sha, label) of every fingerprint in the store; the label is null once compacted."""
        segments = self._segments()
        names = F.create_map(*(F.lit(x) for s in segments for x in (s["segment"], s["label"]))) if segments else F.lit(None)
        label = F.element_at(names, F.col("segment")) if segments else F.lit(None).cast("string")
        rows = self._read(segments)
        return rows.select(F.lower(F.hex("fp")).alias("sha"), label.cast("string").alias("label")).distinct()

    def unseen(self, firsts: DataFrame, label: str) -> DataFrame:
        """Rows of ``firsts`` (one per ``sha``) that no other batch has brought.  Read three times: pass a written table."""
        others = [s for s in self._segments() if s["label"] != label and s["n"] > 0]
        if not others:
            return firsts
        keys = firsts.select(F.unhex("sha").alias("fp"))
        touched = sorted(r["bucket"] for r in keys.select(self._bucket(F.col("fp")).alias("bucket")).distinct().collect())
        known = self._read(others).where(F.col("bucket").isin(touched))  # at most n_buckets of them
        bits = bits_for(firsts.count())
        if bits is not None:
            known = known.where(may_hold(bloom_filter(keys, "fp", bits), F.col("fp"), bits))
        return firsts.join(known.select(F.lower(F.hex("fp")).alias("sha")), "sha", "left_anti")

    # ── Writing ──

    def _segment(self, rows: DataFrame, label: str | None, place: int) -> dict:
        name = uuid.uuid4().hex
        bucketed = rows.withColumn("bucket", self._bucket(F.col("fp"))).repartition("bucket")
        path = f"{self._path}/segments/segment={name}"
        bucketed.write.partitionBy("bucket").parquet(path)
        n = self._read([{"segment": name}]).count() if not rows.isEmpty() else 0
        return {"segment": name, "label": label, "n": n, "place": place, "live": n > 0}

    def add(self, shas: DataFrame, label: str) -> None:
        """Keep the distinct fingerprints in ``shas`` as what the batch brought, in place of what it brought before."""
        kept = [s | {"live": False} if s["label"] == label else s for s in self._segments(live=False)]
        place = 1 + max((s["place"] for s in kept), default=0)
        self._write([*kept, self._segment(shas.select(F.unhex("sha").alias("fp")), label, place)])

    def take(self, firsts: DataFrame, label: str) -> DataFrame:
        """The unseen rows of ``firsts``, which are seen from now on.  Written down on both sides, so later uses
        of the result repeat neither the detection nor the comparison."""
        new = materialise(self.unseen(materialise(firsts, name="firsts"), label), name="new")
        self.add(new.select("sha"), label)
        return new

    def compact(self, keep: int = 2) -> None:
        """Merge all segments but the latest ``keep``; a merged batch can no longer be replaced."""
        live = self._segments()
        old = live[:max(0, len(live) - keep)]
        if len(old) < 2:
            return
        gone = {s["segment"] for s in old}
        kept = [s | {"live": False} if s["segment"] in gone else s for s in self._segments(live=False)]
        self._write([*kept, self._segment(self._read(old).select("fp").distinct(), None, old[-1]["place"])])

    def vacuum(self) -> None:
        """Delete segments that are no longer in force."""
        live = self._segments()
        dead = [s["segment"] for s in self._segments(live=False) if not s["live"]]
        self._write(live)
        discard(self._spark, *(f"{self._path}/segments/segment={name}" for name in dead))
