"""Table operators: everything here is ``DataFrame -> DataFrame``."""
