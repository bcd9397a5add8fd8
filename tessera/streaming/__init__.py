"""Stateful limits: windows over attempts and admission with state."""
