"""Iterative fitting kernels in numpy: one curve pair or curve at a time, many in parallel by groups."""
