"""Stages composed of operators, rendering, the query registry and the command line."""
