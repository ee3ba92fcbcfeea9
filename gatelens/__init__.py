"""gatelens: circuit-benchmark analytics as plain DataFrame-to-DataFrame functions."""
