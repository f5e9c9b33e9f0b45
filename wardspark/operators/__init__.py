"""DataFrame operators: scans, risk, policy, access, memory, analytics."""
