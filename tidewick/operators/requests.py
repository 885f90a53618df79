"""Argument rules of chart, book and health requests."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.buckets import LENGTHS
from ..functions.text import ticker_to_market

#: Fixed values of the request rules.
CHART_DEFAULT, CHART_MAX = 500, 5000
HEALTH_DEFAULT, HEALTH_MAX = 10, 720
FORMATS = ("coingecko",)


def allowed_format(name: str) -> str:
    """A known format, or '' for the default one."""
    return name if name in FORMATS else ""


@dataclass(frozen=True)
class MarketChoice:
    market_id: str = ""
    ticker_id: str = ""

    def __post_init__(self):
        if len(self.market_id) < 2 and len(self.ticker_id) < 2:
            raise ValueError("name a market_id or a ticker_id")

    @property
    def market(self) -> str:
        return self.market_id or ticker_to_market(self.ticker_id)


@dataclass(frozen=True)
class ChartRequest(MarketChoice):
    minutes: int = LENGTHS[0]
    limit: int = 0
    format: str = ""

    def __post_init__(self):
        if self.minutes not in LENGTHS:
            raise ValueError(f"minutes has to be one of {LENGTHS}")
        if self.limit > CHART_MAX and self.minutes != max(LENGTHS):
            raise ValueError(f"limit can't exceed {CHART_MAX}")
        super().__post_init__()

    @property
    def rows(self) -> int:
        return self.limit if self.limit > 0 else CHART_DEFAULT


@dataclass(frozen=True)
class BookRequest(MarketChoice):
    depth: int = 0
    format: str = ""

    def __post_init__(self):
        if self.depth < 0:
            raise ValueError("depth can't be negative")
        super().__post_init__()


def health_minutes(minutes: int, bounded: bool = False) -> int:
    """Minutes to look back; the aggregator's check is bounded."""
    wanted = minutes if minutes > 0 else HEALTH_DEFAULT
    return min(wanted, HEALTH_MAX) if bounded else wanted
