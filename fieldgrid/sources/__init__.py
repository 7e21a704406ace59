"""Sources and sinks: design tables, matrix text, sample tables, listings and quarantine."""
