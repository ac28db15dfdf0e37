"""graph of the engine."""
