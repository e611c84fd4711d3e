"""DataFrame operators: rule scans, joins, guards, reports."""
