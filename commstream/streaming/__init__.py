"""Engine subpackage: streaming."""
