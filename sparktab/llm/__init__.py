"""Operators of a training-data pipeline: one module per operator.

The operators read the columns they name and ignore every other column, so
extra columns with clashing names do no harm.  Per-row work runs in Arrow
batches inside tasks; everything that meets across documents goes through
Spark shuffles of small keys."""
