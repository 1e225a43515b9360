"""Operators that prepare text and vectors for training: each module holds one operator."""
