"""Sources and sinks: image files, and stored tables of results, graphs, arrays, profiles and statistics."""
