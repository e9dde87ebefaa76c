import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from llm_conftest import none, odd, without_id  # noqa: E402, F401
