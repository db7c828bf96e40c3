"""Set-oriented operators: joins, ranking, deltas, identity, findings, checks, verdicts."""
