"""Ingestion as jobs that run beside the caller: state, progress and cancellation, by Spark's job groups."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

STATES = ("Running", "Completed", "Failed", "Cancelled")


@dataclass
class Job:
    name: str
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "Running"
    error: str | None = None
    started: float = field(default_factory=time.time)
    ended: float | None = None
    thread: InheritableThread | None = None


class Jobs:
    """The jobs of one session. What a job does is a function without arguments, such as a write of an ingestion plan."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, {}

    def submit(self, name: str, work: Callable[[], object]) -> str:
        job = Job(name)
        self.jobs[job.job_id] = job

        def run() -> None:
            self.spark.sparkContext.setJobGroup(job.job_id, name, interruptOnCancel=True)
            try:
                work()
                end = "Completed"
            except Exception as e:
                end, job.error = "Failed", str(e).split("\n")[0][:500]
            job.ended = time.time()
            if job.state == "Running":
                job.state = end

        job.thread = InheritableThread(target=run, daemon=True)
        job.thread.start()
        return job.job_id

    def cancel(self, job_id: str) -> bool:
        """Stops the job's running tasks; False if it has ended already."""
        job = self.jobs[job_id]
        if job.state != "Running":
            return False
        job.state = "Cancelled"
        self.spark.sparkContext.cancelJobGroup(job_id)
        return True

    def wait(self, job_id: str, seconds: float | None = None) -> str:
        self.jobs[job_id].thread.join(seconds)
        return self.jobs[job_id].state

    def progress(self, job_id: str) -> dict:
        """State, and tasks done, running and known so far of the job's stages."""
        job, tracker = self.jobs[job_id], self.spark.sparkContext.statusTracker()
        ids = {s for j in tracker.getJobIdsForGroup(job_id) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        stages = [s for s in map(tracker.getStageInfo, ids) if s]
        done, known = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
        return {"job_id": job_id, "name": job.name, "state": job.state, "done": done, "active": sum(s.numActiveTasks for s in stages), "tasks": known, "seconds": round((job.ended or time.time()) - job.started, 3), "error": job.error}

    def table(self) -> DataFrame:
        """A row for each job."""
        return self.spark.createDataFrame([self.progress(j) for j in self.jobs], "job_id string, name string, state string, done long, active long, tasks long, seconds double, error string")
