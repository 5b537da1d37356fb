"""DataFrame -> DataFrame operators of the gradebook."""
