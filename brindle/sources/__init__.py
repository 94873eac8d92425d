"""Sources and sinks: a source-tree reader, and snapshots of the index."""
