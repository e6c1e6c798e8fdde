"""DataFrame operators: sampling, rebalancing, splits, features, metrics, models."""
