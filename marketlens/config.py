"""Connection settings from the environment."""

from __future__ import annotations

import os
import re

# Environment variables and their defaults.
DEFAULTS = {"POSTGRES_HOST": "localhost", "POSTGRES_PORT": "5432", "POSTGRES_USER": "postgres", "POSTGRES_PASSWORD": "postgres", "POSTGRES_DB": "research"}


def settings() -> dict[str, str]:
    """The variables as they are now; a default stands in only where one is unset, not where it is empty."""
    return {name: os.environ.get(name, default) for name, default in DEFAULTS.items()}


def get_connection_url() -> str:
    """The database's URL, without escaping or checks."""
    s = settings()
    return f"postgresql+psycopg://{s['POSTGRES_USER']}:{s['POSTGRES_PASSWORD']}@{s['POSTGRES_HOST']}:{s['POSTGRES_PORT']}/{s['POSTGRES_DB']}"


def redacted(url: str) -> str:
    """A URL fit for printing."""
    return re.sub(r"(://[^:/@]*):[^@]*@", r"\1:***@", url)


def jdbc_options() -> dict[str, str]:
    """Options of Spark's JDBC source for the same database."""
    s = settings()
    return {"url": f"jdbc:postgresql://{s['POSTGRES_HOST']}:{s['POSTGRES_PORT']}/{s['POSTGRES_DB']}", "user": s["POSTGRES_USER"], "password": s["POSTGRES_PASSWORD"], "driver": "org.postgresql.Driver"}
