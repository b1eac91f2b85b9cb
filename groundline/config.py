"""Hyper-parameters of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_size: int = 500
    chunk_overlap: int = 100
    max_section_chars: int = 800
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    dense_weight: float = 0.6
    keyword_weight: float = 0.4
    blend: float = 0.7
    pool: int = 20
    top_k: int = 5
    missing_overlap: float = 0.15
    weak_threshold: float = 0.35
    conflict_pool: int = 4
    evidence_chunks: int = 3
    faithful_at: float = 0.30
    #: Rows a query side may have to be sent to every task; more are handled in blocks or by shuffling.
    send_rows: int = 50_000
    #: Chunk ids as file-name prefix and number, which collide between files; by default they don't.
    compat_chunk_ids: bool = False


@dataclass(frozen=True)
class Paths:
    """Where the engine reads its corpus, lands uploads, and keeps manifests, indices and traces."""

    root: str
    corpus: str
    storage: str

    @classmethod
    def discover(cls, root: str | None = None) -> "Paths":
        """From GROUNDLINE_ROOT, CORPUS_DIR and STORAGE_DIR where they are set, else
        below `root` or the working folder. Local folders are made; URIs are left as
        they are."""
        at = root or os.environ.get("GROUNDLINE_ROOT") or os.getcwd()
        found = cls(at, os.environ.get("CORPUS_DIR") or f"{at}/data/corpus", os.environ.get("STORAGE_DIR") or f"{at}/data/storage")
        for folder in (found.corpus, found.storage):
            if "://" not in folder:
                os.makedirs(folder, exist_ok=True)
        return found
