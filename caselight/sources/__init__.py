"""Sources and sinks: documents, JSON records, results, audit entries, change capture, exports."""
