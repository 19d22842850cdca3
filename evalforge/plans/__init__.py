"""Queries over the driver tables; importing this package registers them all."""

from importlib import import_module

_MODULES = ["comparison", "corpus", "prompts", "text", "runlog", "scoring", "checkpoints", "logs", "io", "plugins", "streams", "evaluation"]

for _m in _MODULES:
    import_module(f"{__name__}.{_m}")

from .registry import ORACLE, QUERIES  # noqa: E402

__all__ = ["ORACLE", "QUERIES"]
