"""Engine subpackage: plans."""
