"""Composite jobs (the three pipelines) and their fixture-bound query builders."""
