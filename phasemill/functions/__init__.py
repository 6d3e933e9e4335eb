"""phasemill.functions."""
