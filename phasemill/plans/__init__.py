"""phasemill.plans."""
