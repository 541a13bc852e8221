"""One exception tree, so a contract error surfaces as itself from every job."""


class AnalyticsError(Exception):
    """Base of everything this package raises on purpose."""


class ContractError(AnalyticsError):
    """An input lacks required columns, or a parameter breaks its contract."""


class MissingDataError(AnalyticsError):
    """A dataset or table that a job needs is absent or empty."""


class DataPreparationError(AnalyticsError):
    """A stored table does not have the schema the job expects."""


class CalculationError(AnalyticsError):
    """A statistic cannot be computed from the given input."""


class ConcurrentWriteError(AnalyticsError):
    """Another writer replaced a table's snapshot in the meantime; nothing was lost, try again."""
