"""Runnable commands: ``python -m chronolens.cli.<name>``."""
