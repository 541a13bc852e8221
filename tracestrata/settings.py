"""Parameters of the jobs. Defaults are the values of the analysed study."""

from __future__ import annotations

from dataclasses import dataclass, field

# Stratification quantiles and the labels of the bins they cut.
QUANTILES = (0.5, 0.9, 0.99)
LABELS = ("Low", "Medium", "High", "Giant")

# Rows of one key that a single task may have to sort before the key is split.
HOT_KEY_ROWS = 5_000_000


@dataclass(frozen=True)
class MinerSettings:
    """Thresholds of dependency-graph discovery (all compared with ``>=``)."""

    dependency: float = 0.95
    and_measure: float = 0.8
    loop_two: float = 0.7
    min_activity: int = 100
    min_edge: int = 100


@dataclass(frozen=True)
class Store:
    """Folders of one event store; any Hadoop-compatible URI works as root."""

    root: str

    @property
    def hourly(self) -> str:
        """Hour partitions of days that are not consolidated yet."""
        return f"{self.root}/events_hourly"

    @property
    def events(self) -> str:
        """Consolidated day partitions, the dataset that analyses read."""
        return f"{self.root}/events"

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def defects(self) -> str:
        """What was wrong with landed files, by hour."""
        return f"{self.root}/defects"


@dataclass(frozen=True)
class AnalysisSettings:
    """One analysis: which days of which dataset, and where results go."""

    dataset: str
    output: str
    start: str
    end: str
    quantiles: tuple[float, ...] = QUANTILES
    labels: tuple[str, ...] = LABELS
    quantile_method: str = "exact"
    miner: MinerSettings = field(default_factory=MinerSettings)
    hot_rows: int = HOT_KEY_ROWS
    # Buckets of the stored event log; as many as the session's shuffle partitions if not given.
    log_buckets: int | None = None

    def path(self, name: str) -> str:
        return f"{self.output}/{name}"
