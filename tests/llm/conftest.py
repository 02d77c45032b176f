import pytest

pytest.importorskip("crosscut.llm")
