"""Engine subpackage: sources."""
