"""Policies as parameters: every decision operator takes one of these frozen records."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScorePolicy:
    """Two severity tiers on one 0..1 score."""

    block: float = 0.90
    flag: float = 0.50


@dataclass(frozen=True)
class NsfwPolicy:
    block_classes: tuple[str, ...] = ("porn", "hentai")
    block: float = 0.70
    flag: float = 0.50
    sexy_flag: float = 0.85


@dataclass(frozen=True)
class ViolencePolicy:
    block: float = 0.82
    flag: float = 0.70
    gore_block: float = 0.70
    gore_flag: float = 0.50
    weapon_flag: float = 0.88


@dataclass(frozen=True)
class WindowPolicy:
    chars: int = 294
    overlap: int = 73
    max_windows: int | None = 6
    boundary_share: float = 0.55
    evidence_chars: int = 240


@dataclass(frozen=True)
class PartPolicy:
    """Limits of the part extractor; ``None`` lifts a limit and keeps whole texts."""

    min_chars: int = 12
    max_chars: int | None = 2000
    max_parts: int | None = 60
    max_unit_chars: int | None = 12000

    @classmethod
    def whole(cls) -> PartPolicy:
        return cls(max_chars=None, max_parts=None, max_unit_chars=None)


@dataclass(frozen=True)
class UnitPolicy:
    min_chars_generic: int = 24
    min_chars_site: int = 4
    split_above: int = 700
    split_min_child: int = 140
    max_images: int = 3


@dataclass(frozen=True)
class SiteRule:
    """What one site's adapter says about a unit, as far as text and address show it."""

    site: str
    id_pattern: str
    id_group: int = 1
    min_chars: int = 4
    no_split: bool = False
    max_images: int = 3


# The rules of the routed sites.
SITE_RULES = (
    SiteRule("twitter", r"status/(\d+)"),
    SiteRule("instagram", r"/(?:p|reel)/[^/?#]+", id_group=0, no_split=True),
    SiteRule("youtube", r"[?&]v=([\w-]+)", no_split=True, max_images=1),
    SiteRule("reddit", r"^(?:[a-z]+://[^/]+)?(/[^?#]*comments/[^?#]+)"),
    SiteRule("generic", r"$^", id_group=0, min_chars=24),
)


@dataclass(frozen=True)
class GroupPolicy:
    """Repeated-sibling detection."""

    min_members: int = 2
    min_chars: int = 24
    max_shapes: int = 2
    max_mean: float = 4000.0
    score_cap: float = 600.0


@dataclass(frozen=True)
class OcrPolicy:
    min_chars: int = 4
    min_confidence: float = 25.0
    stop_score: float = 0.40
    max_bytes: int = 10 * 1024 * 1024


@dataclass(frozen=True)
class MediaPolicy:
    image_retries: int = 2
    ocr_retries: int = 1
    ocr_wait_ms: int = 6000
    retry_queue: int = 30
    video_limit_s: float = 60.0
    frame_offsets: tuple[float, ...] = (0.0, 0.5, 1.0)
    frame_window_s: float = 2.5


@dataclass(frozen=True)
class GatePolicy:
    precision: float = 0.7
    recall: float = 0.7


@dataclass(frozen=True)
class ThresholdPolicy:
    grid_from: int = 5
    grid_to: int = 95
    block_precision: float = 0.80
    block_min_predicted: int = 25
    default_flag: float = 0.5
    default_block: float = 0.9


@dataclass(frozen=True)
class StorePolicy:
    verdict_version: str = "v2"
    image_version: str = "img-v2"
    keep_verdicts: int = 5000
    keep_ids: int = 2000
    keep_media: int = 500
    keep_ocr_texts: int = 250


@dataclass(frozen=True)
class Profiles:
    text: ScorePolicy = field(default_factory=ScorePolicy)
    ocr_text: ScorePolicy = field(default_factory=lambda: ScorePolicy(block=0.70, flag=0.35))
    nsfw: NsfwPolicy = field(default_factory=NsfwPolicy)
    violence: ViolencePolicy = field(default_factory=ViolencePolicy)
    windows: WindowPolicy = field(default_factory=WindowPolicy)
    parts: PartPolicy = field(default_factory=PartPolicy)
    units: UnitPolicy = field(default_factory=UnitPolicy)
    groups: GroupPolicy = field(default_factory=GroupPolicy)
    ocr: OcrPolicy = field(default_factory=OcrPolicy)
    media: MediaPolicy = field(default_factory=MediaPolicy)
    gate: GatePolicy = field(default_factory=GatePolicy)
    thresholds: ThresholdPolicy = field(default_factory=ThresholdPolicy)
    store: StorePolicy = field(default_factory=StorePolicy)


DEFAULT_PROFILES = Profiles()
