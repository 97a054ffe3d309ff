"""Scalar, map, time and template functions as Column builders."""
