"""Sources and sinks: CSV/Excel scans, the run store, JSON sanitising."""

from shelfcast.sources.files import read_csv  # noqa: F401
from shelfcast.sources.runs import load_run, sanitize, save_run  # noqa: F401
