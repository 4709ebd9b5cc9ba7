"""Score aggregation, profiles and their settings."""
