from rowloom.sources.report import ReportDataSource, discover, register

__all__ = ["ReportDataSource", "discover", "register"]
