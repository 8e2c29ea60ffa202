"""Readers, writers and adapters from stored tables to canonical inputs."""
