"""Training-data operators: fingerprints, duplicates, personal data, language,
licences, web archives, packing, language-model scores and source mixing.

Nothing else in the library imports this package.
"""

from importlib import import_module

_MODULES = ["fingerprint", "neardup", "pii", "exactdup", "langid", "licenses", "warc", "packing", "pitmanyor",
            "mixing", "merkle", "urlrep", "collocations"]

for _m in _MODULES:
    import_module(f"{__name__}.{_m}")

from .registry import ORACLE, QUERIES  # noqa: E402

__all__ = ["ORACLE", "QUERIES"]
