"""Parameters, checked before any plan is built, and the fixed limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import DetectionFailed, EnhancementFailed, OrthoFailed

#: Fixed limits and settings.
MAX_BYTES = 512 * 1024 * 1024
RASTER_EXTENSIONS = (".tif", ".tiff")
RPC_EXTENSIONS = (".rpc", ".rpb", ".txt")
SUFFIXES = {"enhance": "_Enhance", "mosaic": "_Mosaic", "ortho": "_Ortho"}
TILE, OVERLAP, LEAST_SIDE = 640, 0.15, 0.3
BATCH, CONFIDENCE, TILE_IOU, GLOBAL_IOU = 8, 0.25, 0.45, 0.5
MIN_OVERLAP, MIN_RESPONSE, MAX_SHIFT = 128, 0.15, 50.0
WATER, VEGETATION = 0.2, 0.18


def _within(error: type[Exception], **bounds: tuple) -> None:
    for name, (value, low, high) in bounds.items():
        if value is None or value != value or value < low or (high is not None and value > high):
            raise error(f"{name} must be from {low} to {high if high is not None else 'any'}: {value}")


@dataclass(frozen=True)
class Enhance:
    brightness: float = 1.0
    contrast: float = 1.0
    saturation: float = 1.0

    def __post_init__(self):
        _within(EnhancementFailed, brightness=(self.brightness, 0, 3), contrast=(self.contrast, 0, 5), saturation=(self.saturation, 0, 4))


@dataclass(frozen=True)
class EnhanceRegions:
    brightness: float = 0.0
    contrast: float = 0.0
    saturation: float = 0.0
    water: float = WATER
    vegetation: float = VEGETATION

    def __post_init__(self):
        _within(EnhancementFailed, brightness=(self.brightness, -1, 1), contrast=(self.contrast, -1, 1), saturation=(self.saturation, -1, 1))


@dataclass(frozen=True)
class Detect:
    classes: str = "0,1,7,8"
    confidence: float = CONFIDENCE
    iou: float = GLOBAL_IOU
    tile: int = TILE
    overlap: float = OVERLAP

    def __post_init__(self):
        _within(DetectionFailed, confidence=(self.confidence, 0.01, 1))

    def class_ids(self) -> list[int]:
        return parse_classes(self.classes)


def parse_classes(text: str) -> list[int]:
    """Numbers between commas; blanks are passed over, and none at all stands for every class."""
    try:
        return [int(x) for x in text.split(",") if x.strip()]
    except ValueError as e:
        raise DetectionFailed(f"classes must be whole numbers between commas: {text!r}") from e


@dataclass(frozen=True)
class Ortho:
    height: float = 0.0
    dst_crs: str = "auto"
    resolution: float | None = None
    resampling: str = field(default="bilinear")

    def __post_init__(self):
        _within(OrthoFailed, height=(self.height, 0, None))
        if self.resolution is not None and not self.resolution > 0:
            raise OrthoFailed(f"resolution must be above 0: {self.resolution}")
        if self.resampling not in ("nearest", "bilinear", "cubic", "lanczos"):
            raise OrthoFailed(f"unknown resampling: {self.resampling}")
