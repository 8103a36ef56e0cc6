"""Readers, writers, data generators and the model registry."""
