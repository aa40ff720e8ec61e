"""Append-only stores over JSON tables: artifacts and job states."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import jobs, lineage
from millrace.sources import io

ARTIFACT = "artifact_id string, artifact_type string, version string, path string, status string, complete boolean, content_hash string, parent_artifact_ids array<string>, created_at string, position long"
EVENT = "event_type string, run_id string, job_id string, old_status string, status string, ts string, seq long"


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


class _Table:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        spark.createDataFrame([], schema).write.mode("append").json(path)

    def rows(self) -> DataFrame:
        """All records; a line that is no record is an error that names it."""
        lines = io.read_jsonl_tolerant(self.spark, self.path, self.schema)
        if bad := lines.where("error is not null").orderBy("file", "line_number").first():
            raise ValueError(f"{bad.file}: line {bad.line_number} is no record")
        return lines.select("record.*")

    def append(self, rows: list[dict]) -> None:
        io.append_jsonl(self.spark.createDataFrame([tuple(r.get(c.split()[0]) for c in self.schema.split(", ")) for r in rows], self.schema).coalesce(1), self.path)


class ArtifactRegistry(_Table):
    """Artifacts by id; the last record of an id counts."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ARTIFACT)

    def latest(self) -> DataFrame:
        return lineage.latest(self.rows(), "artifact_id", F.col("position")).withColumn("complete", F.coalesce("complete", F.lit(False))).withColumn("status", F.coalesce("status", F.lit("SUCCEEDED")))

    def get_by_id(self, artifact_id: str):
        return self.latest().where(F.col("artifact_id") == artifact_id).first()

    def register(self, **artifact) -> bool:
        """False if the same artifact is there; another content under the id is an error."""
        held = self.get_by_id(artifact["artifact_id"])
        content = lineage.content_hash({k: v for k, v in artifact.items() if k != "created_at"})
        if held:
            if held.content_hash != content:
                raise ValueError(f"artifact {artifact['artifact_id']} is registered with other content")
            return False
        position = self.rows().count()
        self.append([{"created_at": utc_now(), "status": "SUCCEEDED", "complete": True, **artifact, "content_hash": content, "position": position}])
        return True

    def is_complete(self, artifact_id: str) -> bool:
        """Whether an artifact succeeded, is marked complete, and is on disk; one that is not registered is an error."""
        own = self.latest().where(F.col("artifact_id") == artifact_id)
        row = lineage.is_complete(own, "path").first()
        if row is None:
            raise KeyError(artifact_id)
        return row.is_complete

    def resolve(self, artifact_type: str):
        """The latest complete and succeeded artifact of a type."""
        usable = self.latest().where((F.col("artifact_type") == artifact_type) & F.col("complete") & (F.col("status") == "SUCCEEDED"))
        return usable.orderBy(F.desc("created_at"), F.desc("position")).first()

    def list_artifacts(self) -> DataFrame:
        return self.latest().orderBy("artifact_type", "version", "artifact_id")

    def ancestors(self, artifact_id: str) -> DataFrame:
        edges = self.latest().select(F.col("artifact_id").alias("child"), F.explode("parent_artifact_ids").alias("parent"))
        return lineage.ancestors(edges, self.spark.createDataFrame([(artifact_id,)], "id string"))


class StateStore:
    """Job states as an event log; a step that is not allowed is rejected.

    A job has a folder of its own with one file for each step, named by its number, so a step
    reads that job's events only, and of two writers of the same step one fails.
    """

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path, run_id
        spark.createDataFrame([], EVENT).write.mode("append").json(f"{path}/job=none/step=0")

    def rows(self, job_id: str | None = None) -> DataFrame:
        at = f"{self.path}/job={lineage.job_key(job_id) if job_id is not None else '*'}/step=*"
        return io.read_jsonl(self.spark, at, EVENT)

    def _last(self, job_id: str):
        try:
            return self.rows(job_id).orderBy(F.desc("seq")).first()
        except AnalysisException:  # the job has no folder yet
            return None

    def get(self, job_id: str) -> str | None:
        row = self._last(job_id)
        return row.status if row else None

    def transition(self, job_id: str, status: str, expected: str | None = None) -> None:
        last = self._last(job_id)
        old, seq = (last.status, last.seq + 1) if last else (None, 0)
        if expected is not None and old != expected:
            raise ValueError(f"job {job_id} is {old}, not {expected}")
        if (old is None and status != "PENDING") or (old is not None and status not in jobs.ALLOWED[old]):
            raise ValueError(f"job {job_id}: {old} -> {status} is not allowed")
        event = [("transition", self.run_id, job_id, old, status, utc_now(), seq)]
        target = f"{self.path}/job={lineage.job_key(job_id)}/step={seq}"
        self.spark.createDataFrame(event, EVENT).coalesce(1).write.mode("errorifexists").json(target)

    def resume(self, job_id: str) -> None:
        """Run a job again that failed, went stale or is in review."""
        if (status := self.get(job_id)) not in jobs.RESUMABLE:
            raise ValueError(f"job {job_id} is {status} and cannot be resumed")
        self.transition(job_id, "RUNNING", status)

    def list_jobs(self) -> DataFrame:
        return jobs.current_state(self.rows())

    def resumable(self) -> DataFrame:
        return self.list_jobs().where(F.col("status").isin(*jobs.RESUMABLE))


def write_metrics(expected: DataFrame, predictions: DataFrame, key: str, metrics: DataFrame, path: str) -> None:
    """Write ``metrics`` only when every expected key has one prediction and no other has any."""
    counts = predictions.groupBy(key).agg(F.count("*").alias("n"))
    joined = expected.select(key).distinct().withColumn("wanted", F.lit(True)).join(counts, key, "full_outer")
    wrong = joined.where("wanted is null or n is null or n <> 1").limit(5).collect()
    if wrong:
        raise ValueError(f"predictions are not complete: {[r[key] for r in wrong]}")
    io.write_jsonl(metrics, path)
