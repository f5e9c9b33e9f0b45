"""End-to-end plans: stage scans and the scan-decide-redact-audit job."""
