"""phasemill.operators."""
