"""Leakage-safe event-risk analytics as composable DataFrame operators."""
