"""Registered queries with the SQL that gives the same rows."""

from . import (browse, checks, documents, files, jobs, keyvalue, load, schemas, search, sql_surface,
               values)
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "browse", "checks", "documents", "files", "jobs", "keyvalue",
           "load", "schemas", "search", "sql_surface", "values"]
