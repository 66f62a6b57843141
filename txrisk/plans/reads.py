"""The read queries over a published lake, each a DataFrame. Nothing found is no rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from txrisk.operators import dashboard, profiles, serving
from txrisk.plans import lake


@dataclass(frozen=True)
class LakeReads:
    """Reads of one published run: the one found when the first of them is made."""

    spark: SparkSession
    root: str

    @cached_property
    def run(self) -> str | None:
        return lake.current_run(self.spark, self.root)

    def _layer(self, layer: lake.Layer) -> DataFrame:
        if self.run is None:
            return self.spark.createDataFrame([], layer.schema)
        return lake.read(self.spark, self.root, layer, self.run)

    def users(self) -> DataFrame:
        return self._layer(lake.BRONZE_USERS)

    def transactions(self) -> DataFrame:
        return self._layer(lake.BRONZE_TRANSACTIONS)

    def enriched(self) -> DataFrame:
        return self._layer(lake.SILVER)

    def matching_alerts(self, **conditions) -> DataFrame:
        """All alerts under the conditions, in no order."""
        return serving.filter_alerts(self._layer(lake.ALERTS), **conditions)

    def alerts(self, *, limit: int = 50, **conditions) -> DataFrame:
        """Ranked alerts; see ``serving.filter_alerts`` for the conditions."""
        return serving.list_alerts(self._layer(lake.ALERTS), limit=limit, **conditions)

    def top_alerts(self, limit: int = 50) -> DataFrame:
        return self.alerts(limit=limit)

    def quality(self, limit: int = 50) -> DataFrame:
        return serving.list_quality(self._layer(lake.DATA_QUALITY), limit)

    def transaction(self, txn_id: str) -> DataFrame:
        return serving.transaction_by_id(self._layer(lake.SILVER), txn_id)

    def history(self, user_id: str, limit: int = 20) -> DataFrame:
        return serving.user_history(self._layer(lake.SILVER), user_id, limit)

    def risk_profile(self, user_id: str) -> DataFrame:
        """Over every transaction of the user."""
        return profiles.user_profile(self._layer(lake.SILVER), user_id, latest=None)

    def all_risk_profiles(self) -> DataFrame:
        return profiles.all_profiles(self._layer(lake.SILVER))

    def kpis(self) -> DataFrame:
        return dashboard.kpis(self.top_alerts())

    def score_series(self) -> DataFrame:
        return dashboard.score_series(self.top_alerts())

    def alert_page(self, number: int) -> DataFrame:
        """A page of the loaded alerts with the labels and route it shows."""
        page = dashboard.page(self.top_alerts(), number)
        return dashboard.with_route(dashboard.with_labels(page))
