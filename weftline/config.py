"""Settings, all with the usual defaults; ``from_conf`` reads overrides from the session (``spark.weftline.*``)."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

#: Suffix, as written, to language.
SUFFIX_LANGUAGE = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust"}
#: Directories that a scan leaves out, beside those whose name begins with a dot.
SKIPPED_DIRS = ["node_modules", "venv", "env", "__pycache__", "build", "dist", "target"]


#: Names and defaults of the settings.
@dataclass(frozen=True)
class Settings:
    embedding_dimension: int = 384
    chunk_size: int = 512
    chunk_overlap: int = 50
    max_file_size: int = 1_000_000
    lexical_weight: float = 0.3
    rerank_weight: float = 0.4
    dedup_threshold: float = 0.97
    boost_top_level: float = 0.05
    boost_recent_edit: float = 0.05
    filter_match_boost: float = 0.02
    top_level_depth: int = 0
    symbol_score: float = 1.5
    symbol_cap: int = 20
    graph_hops: int = 1
    search_limit: int = 10
    pack_limit: int = 5
    embedding_batch: int = 32
    include_residual: bool = False  # also chunk what lies outside definitions

    @property
    def chunk_lines(self) -> int:
        return max(1, self.chunk_size // 60)

    @property
    def chunk_step(self) -> int:
        return max(1, self.chunk_lines - max(1, self.chunk_overlap // 60))

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Settings:
        found = {f.name: spark.conf.get(f"spark.weftline.{f.name}", None) for f in fields(cls)}
        read = lambda k, v: v.lower() in ("true", "1") if isinstance(getattr(cls(), k), bool) else type(getattr(cls(), k))(v)
        return replace(cls(), **{k: read(k, v) for k, v in found.items() if v is not None})
