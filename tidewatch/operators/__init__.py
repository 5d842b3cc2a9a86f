"""DataFrame operators: positions, count windows, chains, forest, alerts, metrics."""
