"""Sources and sinks: corpus folders, question files, index tables, result files."""
