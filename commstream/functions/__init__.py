"""Engine subpackage: functions."""
