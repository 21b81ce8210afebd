import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import docs, nothing, rows  # noqa: E402, F401
