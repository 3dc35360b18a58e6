"""Catalogue schemas, enumerations and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the catalogue.
KINDS = ("text", "code", "ocr", "image", "frame", "transcript")
MODALITIES = ("text", "document", "presentation", "code", "image", "audio", "video")
TEXT_EXTENSIONS = (".txt", ".md", ".markdown")
CODE_EXTENSIONS = (".py", ".java", ".js", ".ts", ".tsx", ".jsx", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".sql")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg")
AUDIO_EXTENSIONS = (".wav", ".mp3", ".flac")
VIDEO_EXTENSIONS = (".mp4", ".mkv")
PRESENTATION_EXTENSIONS = (".pptx", ".ppt")
DOCUMENT_EXTENSIONS = (".pdf",)
SUPPORTED = TEXT_EXTENSIONS + CODE_EXTENSIONS + IMAGE_EXTENSIONS + AUDIO_EXTENSIONS + VIDEO_EXTENSIONS + PRESENTATION_EXTENSIONS + DOCUMENT_EXTENSIONS
EXCLUDED_NAMES = (".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".lodestar", ".aws", ".ssh", ".codex", ".agents")
BOX = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("x", "y", "width", "height"))])
LOCATOR = T.StructType(
    [
        *(T.StructField(c, T.IntegerType()) for c in ("line_start", "line_end", "char_start", "char_end")),
        *(T.StructField(c, T.StringType()) for c in ("language", "parser")),
        *(T.StructField(c, T.IntegerType()) for c in ("page", "slide")),
        *(T.StructField(c, T.StringType()) for c in ("section", "shape")),
        *(T.StructField(c, T.IntegerType()) for c in ("width", "height")),
        T.StructField("boxes", T.ArrayType(BOX)),
        T.StructField("ocr_cache_key", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in ("start_ms", "end_ms")),
    ]
)


@dataclass(frozen=True)
class Settings:
    """What changes the results of queries; defaults are those of the catalogue."""

    chunk_tokens: int = 192
    overlap_tokens: int = 32
    text_floor: float = 0.35
    vision_floor: float = 0.28
    max_file_bytes: int = 50 * 2**20
    rrf_k: int = 60
    limit: int = 10
    snippet_chars: int = 1400
    evidence: int = 3
    rerank_head: int = 20
    field_weights: tuple[int, int, int, int] = (1, 3, 1, 4)
    enable_ocr: bool = True
    enable_vision: bool = True
    enable_media: bool = True
    frame_interval_ms: int = 10_000
    max_frames: int = 1500

    @property
    def candidates(self) -> int:
        return max(50, 5 * self.limit)

    def __post_init__(self) -> None:
        if not 0 <= self.overlap_tokens < self.chunk_tokens:
            raise ValueError("0 <= overlap < budget must hold")
        if not 1 <= self.limit <= 50:
            raise ValueError("limit must lie in 1..50")
