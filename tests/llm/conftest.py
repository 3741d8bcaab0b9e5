from __future__ import annotations

import pytest

pytest.importorskip("tidemark.llm")
