"""Queries of every operator, and SQL for an independent engine; ``files`` adds its own to those of ``engine``."""

from colloq.queries import files as files
