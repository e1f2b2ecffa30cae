"""Seasonal-forecast analytics as DataFrame verbs over long-form tables."""

__version__ = "0.1.0"
