"""The corpus of the fixture, for plain versions that need the language too."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("llm_fixture", Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
all_texts = _module.texts
