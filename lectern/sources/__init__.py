"""Sources and sinks: dictionary folders, registers of names in several formats, workbooks, and tab-separated tables."""
