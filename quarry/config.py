"""Defaults of the jobs, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class JobConfig:
    """Options of all plans; ``compat`` keeps quirks of the CSV data that earlier tools produced (see README)."""

    start_date: date = date(2023, 9, 27)
    end_date: date = field(default_factory=date.today)
    earliest_start: date = date(2023, 9, 27)
    cutoff_date: date = date(2023, 10, 16)
    max_pages: int = 500
    page_size: int = 100
    start_offset: int = 0
    limit_matches: int = 50
    raw_path: str = "data/raw/matches_raw.csv"
    enriched_dirs: tuple[str, ...] = ("data/interim/enriched", "data/interim/enriched_latest_1000", "data/interim/enriched_rest")
    output_dir: str = "data/processed"
    compat: bool = False

    def checked(self) -> JobConfig:
        """self, or an error if the dates make no range."""
        if self.start_date < self.earliest_start:
            raise ValueError(f"start date {self.start_date} is before {self.earliest_start}")
        if self.start_date > self.end_date:
            raise ValueError(f"start date {self.start_date} is after end date {self.end_date}")
        return self
