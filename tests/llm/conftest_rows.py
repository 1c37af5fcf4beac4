"""The odd rows, for tests that add their own."""

from importlib.util import module_from_spec, spec_from_file_location
from pathlib import Path

_spec = spec_from_file_location("odd_rows", Path(__file__).with_name("conftest.py"))
_module = module_from_spec(_spec)
_spec.loader.exec_module(_module)
ROWS = _module.ROWS
