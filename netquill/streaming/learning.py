"""A network's baseline on a stream: flows are learned from until there are enough, then the baseline is armed and flows are scored.

Profiles are a versioned table: a version is complete once its marker is written, after it, and batches join the newest complete
one. ``relearn`` adds a version from given flows while a stream runs; the next micro-batch takes it up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.operators.baseline import baseline_alerts, baseline_features, baseline_score, fit_baseline, learning_set
from netquill.sources.scratch import delete, exists, listed

PARTS = ("profiles", "pooled", "calibration")


class LiveBaseline:
    """Learning until ``min_flows`` unicast flows over ``min_s`` seconds, or ``cap`` flows, have come; then armed."""

    def __init__(self, spark: SparkSession, path: str, min_flows: int = 1500, min_s: float = 600, cap: int = 50_000, alpha: float = 0.001):
        self.spark, self.path, self.min_flows, self.min_s, self.cap, self.alpha = spark, path, min_flows, min_s, cap, alpha

    def version(self) -> int:
        """The newest complete version, 0 while learning."""
        made = listed(self.spark, f"{self.path}/versions")
        return max((int(v) for v in made if exists(self.spark, f"{self.path}/versions/{v}/ready/_SUCCESS")), default=0)

    def phase(self) -> str:
        return "armed" if self.version() else "learning"

    def _save(self, fitted: tuple[DataFrame, DataFrame, DataFrame], version: int) -> None:
        at = f"{self.path}/versions/{version}"
        for name, part in zip(PARTS, fitted):
            part.write.mode("overwrite").parquet(f"{at}/{name}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{at}/ready")

    def relearn(self, conn: DataFrame) -> int:
        """A new version from the first flows of ``conn``."""
        version = self.version() + 1
        self._save(fit_baseline(learning_set(baseline_features(conn), self.min_flows, self.min_s, self.cap)), version)
        return version

    def profiles(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        at = f"{self.path}/versions/{self.version()}"
        return tuple(self.spark.read.parquet(f"{at}/{name}") for name in PARTS)

    def hits(self, batch: DataFrame, number: int) -> DataFrame | None:
        """The anomalous flows of a micro-batch with ``rid``; None while learning.

        A batch that completes the learning set is scored from the first flow after that set. A batch that runs again writes its
        part of the learning set anew; if it had armed the baseline, the same flows are scored."""
        flows = baseline_features(batch)
        version = self.version()
        learned = f"{self.path}/learned"
        if version and not exists(self.spark, f"{learned}/{number}"):
            return self._score(flows)
        flows.write.mode("overwrite").parquet(f"{learned}/{number}")
        stored = self.spark.read.parquet(*[f"{learned}/{n}" for n in listed(self.spark, learned) if int(n) <= number])
        first = learning_set(stored, self.min_flows, self.min_s, self.cap)
        n, span = first.agg(F.count("*"), F.max("ts") - F.min("ts")).first()
        if not (n >= self.cap or n >= self.min_flows and span >= self.min_s):
            return None
        if not version:
            self._save(fit_baseline(first), 1)
        last = first.agg(F.max(F.struct("ts", "rid")).alias("end")).first()["end"]
        return self._score(flows.where((F.col("ts") > last["ts"]) | (F.col("ts") == last["ts"]) & (F.col("rid") > last["rid"])))

    def forget_learning(self) -> None:
        """Delete the flows learned from, once armed."""
        if self.version():
            delete(self.spark, f"{self.path}/learned")

    def _score(self, flows: DataFrame) -> DataFrame:
        profiles, pooled, calibration = self.profiles()
        return baseline_alerts(baseline_score(flows, profiles, pooled), calibration, self.alpha)
