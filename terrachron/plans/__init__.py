"""Stages, their registry and command line, and the queries of the driver contract."""
