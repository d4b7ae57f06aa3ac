"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from shelfcast.functions.exprs import *  # noqa: F401,F403
