"""Errors by the operation that raises them."""

from __future__ import annotations


class ProcessingError(Exception):
    """Any failure of an image operation; code is what a caller would answer with."""

    code = 400


class InvalidImage(ProcessingError):
    pass


class UnsupportedFormat(InvalidImage):
    pass


class FileTooLarge(ProcessingError):
    pass


class EnhancementFailed(ProcessingError):
    pass


class DetectionFailed(ProcessingError):
    pass


class MosaicFailed(ProcessingError):
    pass


class OrthoFailed(ProcessingError):
    pass


def envelope(error: Exception) -> dict:
    """{code, message}: domain errors keep theirs, all others are 500."""
    return {"code": error.code, "message": str(error)} if isinstance(error, ProcessingError) else {"code": 500, "message": "internal error"}
