"""Readers and writers of the stored inputs."""
