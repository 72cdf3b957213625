"""Plans that build fixtures out of the driver tables."""
