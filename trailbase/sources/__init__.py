"""Where candidates and pages come from."""
