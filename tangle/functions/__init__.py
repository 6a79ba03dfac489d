"""Functions of the class-overlap engine."""
