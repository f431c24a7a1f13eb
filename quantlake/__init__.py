"""A PySpark engine for end-of-day market-bar analytics and training-data preparation."""
