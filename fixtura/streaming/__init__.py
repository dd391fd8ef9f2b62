"""Streams over the same keyed tables: the batch operators run on each micro-batch."""
