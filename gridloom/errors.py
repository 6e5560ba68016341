"""What can be wrong with a message."""

from __future__ import annotations


class GribError(Exception):
    kind = "Unknown"


class ParseError(GribError):
    """kind: ReadError, GRIBVersionMismatch, UnknownSectionNumber, EndSectionMismatch, UnexpectedEndOfData, InvalidSectionOrder or NoGridDefinition."""

    def __init__(self, kind: str, detail: object = None):
        super().__init__(kind if detail is None else f"{kind}({detail})")
        self.kind, self.detail = kind, detail


class NotSupported(GribError):
    kind = "NotSupported"

    def __init__(self, what: str, number: int | None = None):
        super().__init__(what if number is None else f"{what}: {number}")
        self.what, self.number = what, number


class DecodeError(GribError):
    kind = "DecodeError"


class LengthMismatch(DecodeError):
    kind = "LengthMismatch"


class InvalidValue(GribError):
    kind = "InvalidValueError"
