"""Column functions: everything here is ``Column -> Column``."""
