"""Event-time and stateful operators."""
