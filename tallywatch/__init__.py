"""Transaction-risk analytics on Spark: rules, features, models, roll-ups, alerts."""

__version__ = "0.1.0"
