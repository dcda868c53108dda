"""See README.md for what lives in ``lexmill.functions``."""
