"""Sources and sinks: items, run logs, sidecars, caches, reports."""
