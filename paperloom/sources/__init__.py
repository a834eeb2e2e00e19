"""Readers and writers. Only this layer knows about files and folders."""
