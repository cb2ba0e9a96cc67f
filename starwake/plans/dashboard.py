"""Entry points that choose the best source a report has: metadata, events, archive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from starwake.functions.times import Moment
from starwake.operators import market as mk
from starwake.operators import reports as rp
from starwake.operators.ranking import first_non_empty
from starwake.operators.rollups import has_categorised_metadata


@dataclass
class Dashboard:
    """The tables a deployment has. ``None`` stands for a table that does not exist."""

    events: DataFrame
    metadata: DataFrame | None = None
    history: DataFrame | None = None
    archive: DataFrame | None = None

    def categorised(self) -> bool:
        """Looked up once per report, as it decides which plan is built at all."""
        if self.metadata is None:
            return False
        return bool(has_categorised_metadata(self.metadata).first()["has_categorised"])

    def _sources(self, *choices: DataFrame | None) -> DataFrame:
        return first_non_empty(*[choice for choice in choices if choice is not None])

    def top_repos(
        self, as_of: Moment, days: int = 7, limit: int = 20, category: str | None = None
    ) -> DataFrame:
        known = self.categorised()
        return self._sources(
            rp.top_repos(self.metadata, self.events, as_of, days, limit, category)
            if known
            else None,
            rp.top_repos_from_events(
                self.events, as_of, days, limit, category, hide_other=not known
            ),
            rp.top_repos_from_archive(self.archive, as_of, days, limit, category)
            if self.archive is not None
            else None,
        )

    def top_starred(self, as_of: Moment, limit: int = 20, category: str | None = None) -> DataFrame:
        return self._sources(
            rp.top_starred_repos(self.metadata, limit, category)
            if self.metadata is not None
            else None,
            rp.top_starred_from_events(self.events, as_of, limit, category),
            rp.top_starred_from_archive(self.archive, limit, category)
            if self.archive is not None
            else None,
        )

    def trending(self, as_of: Moment, limit: int = 20) -> DataFrame:
        """With a history there is no second choice, even if nothing grew."""
        if self.history is not None:
            return rp.trending_week(self.history, as_of, limit)
        return self._sources(
            rp.trending_from_events(self.events, as_of, limit),
            rp.trending_from_archive(self.archive, as_of, limit)
            if self.archive is not None
            else None,
        )

    def absolute_movers(self, as_of: Moment, days: int = 7, limit: int = 6) -> DataFrame:
        return self._sources(
            rp.absolute_movers(rp.movers(self.metadata, self.events, as_of, days), limit)
            if self.metadata is not None
            else None,
            rp.absolute_movers(rp.movers_from_events(self.events, as_of, days), limit),
        )

    def percentage_movers(
        self, as_of: Moment, days: int = 7, limit: int = 6, min_baseline_stars: int = 1000
    ) -> DataFrame:
        return self._sources(
            rp.percentage_movers(
                rp.movers(self.metadata, self.events, as_of, days), limit, min_baseline_stars
            )
            if self.metadata is not None
            else None,
            rp.percentage_movers(
                rp.movers_from_events(self.events, as_of, days), limit, min_baseline_stars
            ),
        )

    def category_summary(self, as_of: Moment) -> DataFrame:
        if self.categorised():
            return self._sources(
                rp.category_summary(self.metadata, self.events, as_of),
                rp.category_summary_per_event(self.events, as_of),
            )
        return self._sources(
            rp.category_summary_from_events(self.events, as_of),
            rp.category_summary_per_event(self.events, as_of),
        )

    def topics(self, as_of: Moment, days: int = 7) -> DataFrame:
        return self._sources(
            rp.topic_breakdown(self.events, as_of, days),
            rp.topic_breakdown(self.archive, as_of, days, mode="date")
            if self.archive is not None
            else None,
        )

    def languages(self, as_of: Moment, days: int = 7) -> DataFrame:
        return self._sources(
            rp.language_breakdown(self.events, as_of, days),
            rp.language_breakdown(self.archive, as_of, days, mode="date")
            if self.archive is not None
            else None,
        )

    def repo(self, repo_name: str, as_of: Moment) -> DataFrame:
        return self._sources(
            rp.repo_lookup(self.metadata, repo_name) if self.metadata is not None else None,
            rp.repo_lookup_from_events(self.events, repo_name, as_of),
        )

    def market(self, as_of: Moment, days: int = 30, limit: int = 5) -> DataFrame:
        known = self.categorised()
        return self._sources(
            mk.market_breakouts(self.metadata, self.events, as_of, days, limit) if known else None,
            mk.market_breakouts_from_events(self.events, as_of, days, limit),
        )

    def market_categories(self, as_of: Moment, days: int = 30, limit: int = 5) -> DataFrame:
        if self.categorised():
            return mk.market_category_movers(self.metadata, self.events, as_of, days, limit)
        return mk.market_category_movers_from_events(self.events, as_of, days, limit)
