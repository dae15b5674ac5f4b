"""Kernels."""
