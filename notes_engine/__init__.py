"""Keyed notes, recall, context assembly, checkpoints and session gating as Spark DataFrame operators."""
