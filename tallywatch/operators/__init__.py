"""The computations: rules, features, roll-ups, listings, models, alerts, reports."""
