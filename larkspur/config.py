"""Settings with types and bounds."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from .functions.text import NGRAM_DEFAULT, ngram_size


@dataclass(frozen=True)
class Settings:
    """A value that is out of bounds is ignored, and the default stays; only the n-gram size is clamped instead."""

    doc_dir: str = "Documents"
    index_interval_s: int = 30
    persist_interval_s: int = 900
    max_transmit_bytes: int = 1 << 20
    remote_scope_public: bool = True
    bm25_ngram: int = NGRAM_DEFAULT
    topic: str = "documents"

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Settings:
        """From text values by field name, such as an environment's."""
        bounds = {"index_interval_s": (5, 86_400), "persist_interval_s": (5, 86_400), "max_transmit_bytes": (16 << 10, 16 << 20)}
        out = {}
        for f in fields(cls):
            raw = values.get(f.name, "").strip()
            if not raw:
                continue
            if f.name in bounds:
                low, high = bounds[f.name]
                if re.fullmatch(r"\+?[0-9]+", raw) and low <= int(raw) <= high:
                    out[f.name] = int(raw)
            elif f.name == "bm25_ngram":
                out[f.name] = ngram_size(int(raw)) if re.fullmatch(r"\+?[0-9]+", raw) else NGRAM_DEFAULT
            elif f.name == "remote_scope_public":
                if raw in ("0", "1"):
                    out[f.name] = raw == "1"
            elif f.name == "topic":
                if re.fullmatch(r"[A-Za-z0-9._-]{1,128}", raw):
                    out[f.name] = raw
            elif len(raw.encode()) <= 512:
                out[f.name] = raw
        return cls(**out)
