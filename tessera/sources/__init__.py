"""Sources and sinks of object tables."""
