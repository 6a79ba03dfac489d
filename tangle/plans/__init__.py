"""Plans of the class-overlap engine."""
