"""Sources and sinks: review logs, user lists, tables and metric records."""
