"""Independent SQL for the registered queries, written for DuckDB."""

from parity.normalize import SQL as _BOARDS
from parity.texts import SQL as _TEXTS
from parity.tools import SQL as _TOOLS

ORACLES = {**_TOOLS, **_BOARDS, **_TEXTS}
