"""ZIP packages behind guardrails: sizes, ratios, encryption and names are checked before a part is read."""

from __future__ import annotations

import io
import zipfile
import zlib
from dataclasses import dataclass

from foliospark import errors as E


@dataclass(frozen=True)
class Limits:
    max_part_bytes: int = 64 << 20
    max_ratio: int = 200
    min_ratio_check_bytes: int = 4 << 20


def enclosed(name: str) -> bool:
    """Whether a name stays within the package."""
    if "\0" in name or name.startswith(("/", "\\")) or (len(name) > 1 and name[1] == ":"):
        return False
    depth = 0
    for part in name.replace("\\", "/").split("/"):
        if part == "..":
            depth -= 1
        elif part not in ("", "."):
            depth += 1
        if depth < 0:
            return False
    return True


class Archive:
    def __init__(self, content: bytes, limits: Limits = Limits()):
        self.limits = limits
        self.content = content
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, NotImplementedError, ValueError, EOFError) as e:
            raise E.EngineError(E.BAD_ZIP, f"corrupted or unsupported ZIP container: {e}") from None

    def names(self) -> list[str]:
        return [i.filename for i in self.zip.infolist() if enclosed(i.filename)]

    def has(self, path: str) -> bool:
        try:
            return not self.zip.getinfo(path).flag_bits & 1
        except KeyError:
            return False

    def read(self, path: str, limits: Limits | None = None) -> bytes:
        limits = limits or self.limits
        try:
            info = self.zip.getinfo(path)
        except KeyError:
            raise E.EngineError(E.MISSING, f"missing required OOXML part: {path}") from None
        if info.flag_bits & 1:
            raise E.EngineError(E.ENCRYPTED, f"unsupported encrypted OOXML part: {path}")
        if info.is_dir():
            raise E.EngineError(E.BAD_ENTRY, f"suspicious OOXML ZIP entry: {path}: entry is a directory")
        if not enclosed(info.filename):
            raise E.EngineError(E.BAD_ENTRY, f"suspicious OOXML ZIP entry: {path}: entry name leaves the package")
        self._fits(path, info.file_size, limits)
        if info.file_size >= limits.min_ratio_check_bytes and (info.compress_size == 0 or info.file_size / info.compress_size > limits.max_ratio):
            raise E.EngineError(E.BAD_ENTRY, f"suspicious OOXML ZIP entry: {path}: compression ratio is too high")
        if (plain := self._plain(info)) is not None:
            return plain
        try:
            with self.zip.open(info) as f:
                data = f.read(limits.max_part_bytes + 1)
        except NotImplementedError as e:
            raise E.EngineError(E.BAD_ZIP, f"corrupted or unsupported ZIP container: {e}") from None
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError) as e:
            raise E.EngineError(E.IO, f"I/O error: {path}: {e}") from None
        self._fits(path, len(data), limits)
        return data

    def _plain(self, info: zipfile.ZipInfo) -> bytes | None:
        """A stored or deflated part whose headers, size and checksum agree, without a file object; None leaves it to zipfile, which says what is wrong."""
        at, n = info.header_offset, len(info.orig_filename)
        if info.flag_bits or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or not info.orig_filename.isascii() or at < 0:
            return None
        head = self.content[at : at + 30 + n]
        if len(head) < 30 + n or head[:4] != b"PK\3\4" or int.from_bytes(head[26:28], "little") != n or head[30:] != info.orig_filename.encode():
            return None
        begin = at + 30 + n + int.from_bytes(head[28:30], "little")
        end = begin + info.compress_size
        # Entries that overlap are refused by zipfile, which knows where each may end.
        last = getattr(info, "_end_offset", None)
        if end > len(self.content) or (last is not None and end > last):
            return None
        data = self.content[begin:end]
        if info.compress_type == zipfile.ZIP_DEFLATED:
            reader = zlib.decompressobj(-15)
            try:
                data = reader.decompress(data, info.file_size + 1)
            except zlib.error:
                return None
            if not reader.eof:
                return None
        return data if len(data) == info.file_size and zlib.crc32(data) == info.CRC else None

    def text(self, path: str) -> bytes:
        """A part that must be UTF-8."""
        data = self.read(path)
        try:
            data.decode("utf-8")
        except UnicodeDecodeError as e:
            raise E.EngineError(E.IO, f"I/O error: {path}: {e.reason}") from None
        return data

    @staticmethod
    def _fits(path: str, size: int, limits: Limits) -> None:
        if size > limits.max_part_bytes:
            raise E.EngineError(E.TOO_LARGE, f"part {path} has {size} bytes, over the limit of {limits.max_part_bytes}")
