"""Sources of the class-overlap engine."""
