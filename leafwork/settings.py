"""Options of the document dataflow, from the environment where it has them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from .operators import grouping
from .operators.translate import Options


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values. compat lowers the batch sizes and turns the fallbacks on."""

    session_ttl_minutes: int = 120
    max_upload_mb: int = 30
    render_dpi: int = 160
    max_retries_per_provider: int = 1
    batch_segment_size: int = grouping.MAX_BLOCKS
    batch_segment_char_limit: int = grouping.MAX_CHARS
    enable_single_block_fallback: bool = False
    enable_strict_low_quality_retry: bool = True
    clear_translation_memory_on_retry: bool = True
    compat: bool = False
    compat_batch_segment_size: int = grouping.COMPAT_BLOCKS
    compat_batch_segment_char_limit: int = grouping.COMPAT_CHARS
    glossary_max_terms: int = 12
    style_profile: str = "academic_conservative"
    ocr_job_url: str = ""
    ocr_token_variable: str = "OCR_TOKEN"
    ocr_model: str = ""
    ocr_timeout_sec: int = 30
    ocr_poll_interval_sec: int = 5
    ocr_max_wait_sec: int = 180
    grobid_base_url: str = ""
    grobid_timeout_sec: int = 30

    @classmethod
    def load(cls, environment: Mapping[str, str] | None = None) -> Settings:
        """Fields named LEAFWORK_<FIELD> in the environment, over the defaults."""
        env = os.environ if environment is None else environment
        found = {}
        for f in fields(cls):
            raw = env.get(f"LEAFWORK_{f.name.upper()}")
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**found).effective()

    def effective(self) -> Settings:
        if not self.compat:
            return self
        return replace(
            self, enable_single_block_fallback=True, enable_strict_low_quality_retry=True, clear_translation_memory_on_retry=True,
            batch_segment_size=max(1, min(self.batch_segment_size, self.compat_batch_segment_size)),
            batch_segment_char_limit=max(1200, min(self.batch_segment_char_limit, self.compat_batch_segment_char_limit)),
        )

    @property
    def zoom(self) -> float:
        return self.render_dpi / 72

    def options(self) -> Options:
        return Options(max_blocks=self.batch_segment_size, max_chars=self.batch_segment_char_limit, retries=self.max_retries_per_provider, single_fallback=self.enable_single_block_fallback, strict_repair=self.enable_strict_low_quality_retry, style="" if self.style_profile == "academic_conservative" else self.style_profile)
