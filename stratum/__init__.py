"""Temporal state engine on Spark: height-versioned entities, snapshots, forks."""
