"""DataFrame -> DataFrame operators of the study."""
