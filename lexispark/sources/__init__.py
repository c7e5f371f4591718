"""Sources and sinks: text lines, paired labels, hint files, results as JSON, and session snapshots."""
