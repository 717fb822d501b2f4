"""Column functions and the slots for models given by the caller."""
