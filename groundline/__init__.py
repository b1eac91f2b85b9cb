"""Evidence-first analytics over documents, on Spark DataFrames."""

from groundline.config import Config, Paths
from groundline.plans.engine import Chunker, Engine, Gate, Tracer, chunk_files, retrieve
from groundline.session import local_session

__all__ = ["Chunker", "Config", "Engine", "Gate", "Paths", "Tracer", "chunk_files", "local_session", "retrieve"]
