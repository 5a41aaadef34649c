"""The append sink: one writer, private file, whole lines or nothing."""

from __future__ import annotations

import fcntl
import json
import os
import stat
import threading
from pathlib import Path


class OutputInUse(OSError):
    """Another process appends to the file."""


class Poisoned(OSError):
    """A write failed and could not be taken back; the file takes no more lines."""


class NdjsonAppender:
    """Appends JSON values as lines under an exclusive lock that readers do not notice."""

    def __init__(self, path: str | Path):
        self._fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND | os.O_CLOEXEC, 0o600)
        try:
            if not stat.S_ISREG(os.fstat(self._fd).st_mode):
                raise OSError(f"{path} is no regular file")
            os.fchmod(self._fd, 0o600)
            fcntl.flock(self._fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            os.close(self._fd)
            raise OutputInUse(f"{path} is in use") from None
        except OSError:
            os.close(self._fd)
            raise
        self._mutex, self._failed = threading.Lock(), False

    def append(self, value: object) -> None:
        line = json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode() + b"\n"
        with self._mutex:
            if self._failed:
                raise Poisoned("an earlier write failed")
            before = os.fstat(self._fd).st_size
            try:
                self._write(line)
            except OSError as e:
                self._failed = True
                try:
                    os.ftruncate(self._fd, before)
                except OSError as second:
                    raise Poisoned(f"{e}; the partial line could not be taken back: {second}") from e
                raise

    def _write(self, data: bytes) -> None:
        while data:
            data = data[os.write(self._fd, data) :]

    def close(self) -> None:
        os.close(self._fd)

    def __enter__(self) -> NdjsonAppender:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
