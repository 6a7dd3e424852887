"""A small session and whole tables as pandas."""

from __future__ import annotations

import os

import pytest

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def pytest_collection_modifyitems(items):
    for item in items:
        if "llm" in str(item.fspath):
            item.add_marker(pytest.mark.llm)


def pytest_configure(config):
    config.addinivalue_line("markers", "llm: operators for training corpora")
