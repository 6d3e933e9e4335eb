"""phasemill.sources."""
