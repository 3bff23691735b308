"""DataFrame operators: term statistics and ranking, passages, profiles, verdicts, export."""
