"""Session set-up and plan-level helpers shared by the operators."""
