"""Nothing outside the llm subpackage imports it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_only_the_entry_point_names_llm():
    for p in (ROOT / "factloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "factloom").parts:
            assert not re.search(r"factloom\.llm|from \.llm|import llm", p.read_text()), p
