"""The error and warning vocabulary: failures and oddities are data, with stable codes."""

from __future__ import annotations

IO, BAD_ZIP, MISSING, ENCRYPTED, TOO_LARGE, BAD_ENTRY, BAD_TARGET, NO_CORE, BAD_XML, ARGUMENT = (f"E{i:03}" for i in range(1, 11))
#: Warnings: malformed XML, a sheet without name or id, shared strings out of bounds or not a number, skipped input, others.
W_XML, W_SHEET, W_BOUNDS, W_INDEX, W_SKIPPED, W_OTHER = "W001", "W002", "W003", "W004", "W998", "W999"
CATEGORY = {W_XML: "parser", W_SHEET: "data", W_BOUNDS: "data", W_INDEX: "data", W_SKIPPED: "batch", W_OTHER: "custom"}
WARNING_TYPE = "struct<category: string, code: string, path: string, message: string>"
ERROR_TYPE = "struct<code: string, message: string>"


class EngineError(Exception):
    """A failure with its code; target and reason are set for suspicious relationship targets."""

    def __init__(self, code: str, message: str, target: str | None = None, reason: str | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.target, self.reason = code, message, target, reason

    def __reduce__(self):
        return EngineError, (self.code, self.message, self.target, self.reason)


def warning(code: str, path: str, message: str) -> dict:
    return {"category": CATEGORY[code], "code": code, "path": path, "message": message}


def malformed(path: str, what: object) -> dict:
    return warning(W_XML, path, f"stopped after malformed XML: {what}")
