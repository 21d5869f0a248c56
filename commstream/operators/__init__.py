"""Engine subpackage: operators."""
