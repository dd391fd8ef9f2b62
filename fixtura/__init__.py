"""Point-in-time analytics on Spark: leakage-safe panels, frozen forecasts and their scores, as DataFrame operators."""
