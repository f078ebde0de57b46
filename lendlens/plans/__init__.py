"""Composed plans: the study's preparation pipeline and the query catalog."""
