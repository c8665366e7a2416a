"""Where the test tables are."""

from pathlib import Path

DATA = Path("/root/testdata")
