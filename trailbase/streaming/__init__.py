"""The run's event log as a stream."""
