"""Query plans registered with the driver."""
