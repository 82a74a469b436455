"""Numbers on the driver and in tasks: bases, fits from moments, evaluation."""
