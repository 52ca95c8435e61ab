"""Settings of a job: fixed defaults, overlaid with what is given, brought up to the present version."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

VERSION = 2


@dataclass(frozen=True)
class Settings:
    """Defaults and limits of a job. No endpoint is set."""

    prefs_version: int = VERSION
    base_url: str = ""
    model: str = ""
    parallel_pages: int = 4
    request_timeout: int = 180
    auto_retry_attempts: int = 3
    max_tokens_per_page: int = 65536
    toc_max_tokens: int = 65536
    toc_chunk_size: int = 60
    vision_max_image_side: int = 2400
    cover_max_image_side: int = 1200
    cover_scan_pages: int = 5
    cover_multi_image: bool = True
    detect_cover: bool = True
    keep_recovery_cache: bool = True


#: Least and largest value of a setting.
RANGES = {
    "parallel_pages": (1, 8), "request_timeout": (30, 1800), "auto_retry_attempts": (0, 20), "max_tokens_per_page": (512, 65536),
    "toc_max_tokens": (1024, 131072), "toc_chunk_size": (10, 500), "cover_scan_pages": (1, 1 << 30),
}


def overlaid(given: Mapping[str, object] | None = None) -> Settings:
    """Defaults with the given values; unknown names are ignored, numbers kept within their range.

    Settings of an older version lose their ``keep_recovery_cache`` and become the present version."""
    known = {f.name: f.default for f in fields(Settings)}
    own = {k: v for k, v in (given or {}).items() if k in known and v is not None}
    if int(own.get("prefs_version", 0) or 0) < VERSION:
        own.pop("keep_recovery_cache", None)
        own["prefs_version"] = VERSION
    for name, (low, high) in RANGES.items():
        if name in own:
            own[name] = max(low, min(high, int(own[name])))
    return Settings(**(known | own))
