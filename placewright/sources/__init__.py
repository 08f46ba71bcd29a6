"""Sources and sinks: DXF drawings, feature files, the rule catalogue."""
