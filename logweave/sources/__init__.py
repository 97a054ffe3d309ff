"""Decoders of wire formats, file readers, and sinks."""
