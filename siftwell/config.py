"""Settings of a run, their checks, and what of them may be logged."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Settings:
    """Defaults are part of the semantics. ``secrets`` are provider credentials by name."""

    providers: tuple[str, ...] = ("perplexity", "google")
    strategy: str = "fallback"
    search_timeout_s: float = 15.0
    max_results: int = 10
    max_retries: int = 1
    breaker_threshold: int = 3
    job_timeout_s: float = 600.0
    search_stage_timeout_s: float = 300.0
    crawl_stage_timeout_s: float = 180.0
    concurrent_jobs: int = 2
    queued_jobs: int = 20
    fetch_concurrency: int = 5
    per_host: int = 1
    job_fetch_concurrency: int | None = None
    extraction_backlog: int = 4
    extraction_concurrency: int = 2
    max_urls: int = 30
    max_text_chars: int = 1_000_000
    max_total_text_chars: int = 30_000_000
    secrets: dict[str, str | None] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if self.strategy not in ("fallback", "fanout"):
            raise ValueError("strategy: fallback or fanout")
        if self.max_urls * self.max_text_chars > self.max_total_text_chars:
            raise ValueError(f"text budget exceeded: {self.max_urls} URLs x {self.max_text_chars} characters > {self.max_total_text_chars}")

    @property
    def per_job(self) -> int:
        """Fetches of one job at a time."""
        return self.job_fetch_concurrency or math.ceil(self.fetch_concurrency / max(self.concurrent_jobs, 1))

    @property
    def bodies(self) -> int:
        """Bodies held at a time: being fetched, waiting for extraction, being extracted."""
        return self.fetch_concurrency + self.extraction_backlog + self.extraction_concurrency

    def summary(self) -> dict:
        """The settings for a log: of credentials only whether they are there."""
        shown = {k: v for k, v in asdict(self).items() if k != "secrets"}
        return shown | {"credentials": [{"name": k.upper(), "status": "CONFIGURED" if v else "MISSING"} for k, v in sorted(self.secrets.items())]}
