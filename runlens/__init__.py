"""Analytics over the telemetry of large automated test suites, as DataFrame functions."""
