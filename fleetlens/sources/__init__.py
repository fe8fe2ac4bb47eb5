"""Sources: landed telemetry (parquet, batch or stream) and the stand-in
telemetry derived from the test tables."""

from .telemetry import LandedTelemetry, Telemetry, read_landed, write_landed

__all__ = ["LandedTelemetry", "Telemetry", "read_landed", "write_landed"]
