"""Sources and sinks: event logs, sample records and the metric store."""
