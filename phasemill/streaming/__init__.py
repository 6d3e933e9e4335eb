"""phasemill.streaming."""
